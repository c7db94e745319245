import collections

import duckdb
from helpers import documents, with_clashes
from sentimetry.llm import line_dedup as op


def brute(rows, ratio, least):
    pages, having = collections.Counter(), collections.Counter()
    trim = lambda x: x.strip(" \t\r\f\v")
    for _, text, _, host in rows:
        pages[host] += 1
        having.update((host, x) for x in {trim(x) for x in (text or "").split("\n")} if x)
    out = []
    for i, text, _, host in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (trim(x) and having[host, trim(x)] >= least and having[host, trim(x)] > ratio * pages[host])]
        whole = text is None or not any(map(trim, kept)) or len(kept) == len(lines)
        out.append((i, text, 0) if whole else (i, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


def table():
    rows = [(i, f"Menu | home\nunique {i}\n \n  Terms apply. \nmore {i % 7}", "en", "a") for i in range(30)]
    rows += [(30 + i, f"only {i}\nMenu | home", "en", "b") for i in range(3)]  # too few pages
    rows += [(40 + i, "Menu | home\nTerms apply.", "en", "a") for i in range(3)]  # nothing else on the page
    rows += [(50 + i, f"x{i}\nshared" + "\nshared" * 3, "en", None) for i in range(8)]
    rows += [(60, None, "en", "a"), (61, "", "en", "a"), (62, "line\n" * 5000, "en", "a"), (50, "x0\nshared", "en", None), (None, "Menu | home\nq", None, "a")]
    return rows


def test_against_counts_and_sql(spark):
    docs = documents(spark, table())
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in op.drop_boilerplate(with_clashes(docs)).collect()), key=repr)
    assert got == brute(table(), 0.1, 5)
    pdf = docs.toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", pdf)
    assert sorted(con.execute(op.line_dedup_sql()).fetchall(), key=repr) == got


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_LINES", -1)
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in op.drop_boilerplate(documents(spark, table())).collect()), key=repr)
    assert got == brute(table(), 0.1, 5)


def test_columns_stay(spark):
    docs = with_clashes(documents(spark, table()))
    assert op.drop_boilerplate(docs).columns == [*docs.columns, "lines_dropped"]
    assert op.drop_boilerplate(docs.where("false")).collect() == []


def test_ratio_bounds(spark):
    rows = [(i, ("common\n" if i < 10 else "") + f"own {i}", "en", "h") for i in range(100)]
    assert sum(r.lines_dropped for r in op.drop_boilerplate(documents(spark, rows)).collect()) == 0  # just the ratio
    rows.append((100, "common\nown", "en", "h"))
    assert sum(r.lines_dropped for r in op.drop_boilerplate(documents(spark, rows)).collect()) == 11


def test_no_python_on_the_main_path(spark):
    plan = op.drop_boilerplate(documents(spark, table()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
