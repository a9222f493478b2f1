import random

import pytest

from sealwright.llm import line_dedup as m

from .conftest import odd_texts


def brute(rows):
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    seen, covered = set(), {}
    for known, d, t in order:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        covered[known, d, t] = gone
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0, 0))
            continue
        lines, gone = t.split("\n"), covered[d is not None, d or 0, t]
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(i - 1 not in gone for i in gone)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, make):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * rng.choice([0, 1, 2]) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(300, "q\n" * 50), (301, "l1\nl2\nl3\nl4"), (302, "l1\nl2\nl3\nl4\nl5"), (303, "\n\n\n\n"), (None, "l2\nl3\nl4"), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(400 + i, x) for i, x in enumerate(odd_texts(rng))]
    out = m.dedup_lines(make(rows))
    assert out.columns == make(rows).columns + ["kept_text", "n_lines", "n_removed", "n_spans"]
    got = [(r["doc_id"], r["kept_text"], r["n_lines"], r["n_removed"], r["n_spans"]) for r in out.collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_no_python_in_the_plan(spark, make):
    plan = m.dedup_lines(make([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_empty(spark, make, rows):
    assert [(r["n_removed"], r["n_spans"]) for r in m.dedup_lines(make(rows)).collect()] == [(0, 0)] * len(rows)
