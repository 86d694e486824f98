"""License templates against regular expressions made from the same markup, and whole licenses in many forms."""

import random
import re

import pytest

from attesta.llm import licenses

MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
FILL = {"1|a": ["1", "a"], "2|b": ["2", "b"], "3|c": ["3", "c"], "1": ["1"], "2": ["2"], "3": ["3"], "names?": ["name", "names"], r"\d+": ["2", "3"], "acknowledge?ment": ["acknowledgment", "acknowledgement"]}


def parts(markup):
    at = 0
    for m in MARK.finditer(markup):
        yield from markup[at : m.start()].split()
        yield m
        at = m.end()
    yield from markup[at:].split()


def region(m):
    amount, _, pattern = m[1][4:].partition(";")
    low, _, high = amount.rpartition("-")
    return int(low or 0), int(high), pattern


def expression(markup):
    """The markup over words that are each followed by a space."""
    out = []
    for x in parts(markup):
        if isinstance(x, str):
            out.append(re.escape(x) + " ")
        elif x[1] == "beginOptional":
            out.append("(?:")
        elif x[1] == "endOptional":
            out.append(")?")
        else:
            low, high, pattern = region(x)
            out.append(f"(?:(?:{pattern or '[^ ]+'}) ){{{low},{high}}}")
    return re.compile("".join(out))


def written(markup, rng):
    """(words, whether each is mandatory) of a text of the markup."""
    out, skipped, kept = [], 0, []
    for x in parts(markup):
        if not isinstance(x, str) and x[1] == "beginOptional":
            skip = bool(skipped) or rng.random() < 0.5
            kept.append(skip)
            skipped += skip
        elif not isinstance(x, str) and x[1] == "endOptional":
            skipped -= kept.pop()
        elif skipped:
            continue
        elif isinstance(x, str):
            out.append((x, not kept))
        else:
            low, high, pattern = region(x)
            choice = FILL.get(pattern) or (pattern.split("|") if pattern and "?" not in pattern else ["http", "www"] if pattern else ["acme", "2024"])
            out += [(rng.choice(choice), False) for _ in range(rng.randint(low, high))]
    return out


@pytest.mark.parametrize("label, markup", licenses.WHOLE, ids=[x for x, _ in licenses.WHOLE])
def test_whole_licenses_in_all_forms(label, markup):
    rng, automaton, said = random.Random(label), licenses.compile_template(label, markup), expression(markup)
    for _ in range(25):
        text = written(markup, rng)
        words = [w for w, _ in text]
        assert said.fullmatch("".join(w + " " for w in words))
        assert automaton.accepts([w.encode() for w in words], 0) == len(words)
        at = rng.choice([i for i, (_, must) in enumerate(text) if must])
        for other in ([*words[:at], "zzz", *words[at + 1 :]], words[:at] + words[at + 1 :], [*words[:at], "zzz", *words[at:]]):
            ends = [e for e in range(len(other) + 1) if said.fullmatch("".join(w + " " for w in other[:e]))]
            assert automaton.accepts([w.encode() for w in other], 0) == max(ends, default=None)


def test_random_templates_against_regular_expressions():
    rng = random.Random(8)

    def markup(depth=0):
        out = ["a"] if not depth else []
        for _ in range(rng.randint(1, 4)):
            x = rng.random()
            if x < 0.2 and depth < 3:
                out += ["<<beginOptional>>", *markup(depth + 1), "<<endOptional>>"]
            elif x < 0.45:
                low = rng.randint(0, 2)
                out.append(f"<<var;{low}-{low + rng.randint(0, 2)}{rng.choice(['', ';b', ';b|c', ';[ab]'])}>>")
            else:
                out.append(rng.choice("abc"))
        return out

    accepted = 0
    for _ in range(400):
        template = " ".join(markup())
        automaton, said = licenses.compile_template("x", template), expression(template)
        for _ in range(10):
            words = ["a", *rng.choices("abc", k=rng.randint(0, 12))]
            ends = [e for e in range(len(words) + 1) if said.fullmatch("".join(w + " " for w in words[:e]))]
            assert automaton.accepts([w.encode() for w in words], 0) == max(ends, default=None), template
            accepted += bool(ends)
    assert accepted > 1000


def test_whole_licenses_through_the_scan(spark):
    rng, texts, want = random.Random(9), [], []
    for label, markup in licenses.WHOLE:
        words = [w for w, _ in written(markup, rng)]
        quoted = " ".join(f"“{w.upper()}”," if i % 7 == 3 else f"— {w}" if i % 11 == 5 else w for i, w in enumerate(words))
        texts += [f"Copyright © 2024 Acme\n\n{' '.join(words)}\nEnd", f"x {quoted} y", " ".join(words[: len(words) // 2]), " ".join(words[:-2])]
        want += [{label}, {label}, set(), set()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, labels in enumerate(want):
        assert {x for x in got[i]["labels"].split(",") if ":" in x} == labels, (i, texts[i])
        assert got[i]["score"] == 1.0 or not labels


def test_bounds_of_regions():
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<var;3-2>> b")
    a = licenses.compile_template("x", "a <<var;1-2;b|cc>> d")
    accepts = lambda text: a.accepts(text.encode().split(), 0)
    assert [accepts(t) for t in ("a d", "a b d", "a cc b d", "a b b b d", "a c d")] == [None, 3, 4, None, None]


def test_many_beginnings_take_linear_time(spark):
    import timeit

    once = "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    spaced = [(licenses.normal(p.encode()), label) for p, label in licenses.PHRASES]
    automata = [licenses.compile_template(*t) for t in licenses.TEMPLATES + licenses.WHOLE]
    spent = [min(timeit.repeat(lambda n=n: licenses.scan_text((once * n).encode(), spaced, automata), number=1, repeat=2)) for n in (400, 1600)]
    assert spent[1] < 10 * spent[0]
