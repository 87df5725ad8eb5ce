"""Licence scans: against exact containment, in Python and in SQL, and native plans only."""

import io
import re
from contextlib import redirect_stdout

import duckdb
import pytest

from gradewell.llm import licenses, queries

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def slow_scan(rows, templates, least=0.8):
    out = []
    for i, text in rows:
        mine = shingle_set(text)
        for name, body in templates.items():
            want = shingle_set(body)
            if want and len(mine & want) / len(want) >= least:
                out.append((i, name, len(mine & want)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.license, r.n_shared) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op5_license_scan"]).fetchall()
    got = [tuple(r) for r in queries.op5_license_scan(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("max_keys", [50_000, 1])
def test_edited_notices(spark, monkeypatch, max_keys):
    monkeypatch.setattr(licenses, "MAX_KEYS", max_keys)
    filler = " ".join(f"word{i}" for i in range(23))
    rows = []
    for n, (name, body) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = body.split()
        for k in range(0, len(words), 3):  # one word changed anywhere
            rows.append((1000 * n + k, f"{filler[: 7 * (k % 9)]} " + " ".join(words[:k] + ["Changed"] + words[k + 1 :]).upper() + "; " + filler))
        rows += [(1000 * n + 900 + c, filler + " " + " ".join(words[c:]) + " end") for c in range(4)]  # beginnings cut off
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(licenses.scan(docs)) == slow_scan(rows, licenses.TEMPLATES)


@pytest.mark.parametrize("max_keys, most", [(50_000, 0), (1, 1_000_000), (1, 0)])
def test_shingles_that_lie_apart(spark, monkeypatch, max_keys, most):
    """Templates whose hashes are never first in a window, each shingle of them far from the others."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(licenses, "MAX_KEYS", max_keys)
    monkeypatch.setattr(licenses, "MAX_BROADCAST", most)
    pool = [" ".join(f"t{i}w{k}" for k in range(10)) for i in range(3000)]
    hashed = licenses.with_shingles(spark.createDataFrame([(i, p) for i, p in enumerate(pool)], "i int, text string"), "text", F.col("i"))
    low = [r._c0 for r in hashed.orderBy(F.array_max("_h")).limit(20).collect()]
    templates = {f"L{i}": pool[i] for i in low}
    rows = []
    for n, i in enumerate(low):
        words = pool[i].split()
        shingles = [" ".join(words[k : k + 5]) for k in range(6)]
        for gone in range(6):  # five of the six, apart from each other and in another order
            rest = [s for k, s in enumerate(shingles) if k != gone][::-1]
            rows.append((100 * n + gone, " ".join(f"{s} " + " ".join(f"f{n}x{gone}y{j}z{k}" for k in range(12)) for j, s in enumerate(rest))))
        rows.append((100 * n + 50, " filler ".join(shingles[:4])))  # four of six: too few
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    want = slow_scan(rows + rows[:1], templates)
    assert found(licenses.scan(docs, templates)) == want and len(want) == 121


def test_edges(spark):
    notice = licenses.TEMPLATES["MIT"]
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (None, notice, "x"), (4, notice, "x"), (4, notice, "x"), (5, "x " * 100_000 + notice, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert found(licenses.scan(docs)) == slow_scan([r[:2] for r in rows], licenses.TEMPLATES)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, {"tiny": "two words"}).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_plan_is_native(spark):
    with redirect_stdout(io.StringIO()) as out:
        queries.op5_license_scan(spark, SF).explain()
    assert not re.search("Python|Pandas|Arrow|Exchange", out.getvalue())
