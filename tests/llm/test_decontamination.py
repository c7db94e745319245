import hashlib
import random
import re

import duckdb
from helpers import documents, lorem, with_clashes
from sentimetry.llm import decontamination as op


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            size = min(13, len(b))
            grams = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables(spark):
    rng = random.Random(1)
    items = [(k, lorem(rng, n, 10**6)) for k, n in enumerate([40, 13, 12, 30, 14, 200])]
    items += [(10, "Only Three words"), (11, "one"), (12, ""), (13, None), (2, items[0][1]), (100, items[3][1]), (14, "Größe zählt, ja")]
    say = lambda k, a, b: " ".join(items[k][1].split()[a:b])
    rows = [(i, lorem(rng, rng.randrange(0, 60))) for i in range(20)]
    rows += [(20, lorem(rng, 20) + " " + items[0][1].upper() + "! " + lorem(rng, 30)), (21, say(0, 0, 12)), (22, say(0, 3, 16)), (23, lorem(rng, 300) + " " + say(3, 5, 18))]
    rows += [(24, say(0, 0, 20) + " x " + say(0, 10, 40)), (25, items[1][1].replace(" ", ",\n")), (26, items[2][1]), (27, "only three words only three words"), (28, "gone in one go")]
    rows += [(29, None), (30, ""), (31, "größe ZÄHLT ja"), (None, items[4][1]), (20, items[5][1]), (20, "nothing"), (32, (items[5][1] + " ") * 40)]
    return rows, items


def digest(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string") if items else spark.createDataFrame([], "item_id long, text string")
    return sorted(map(tuple, op.digest(op.contamination(with_clashes(documents(spark, rows)), bench)).collect()), key=repr)


def test_against_all_windows_and_sql(spark):
    rows, items = tables(spark)
    want = brute(rows, items)
    assert digest(spark, rows, items) == want
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(op.decontamination_sql()).fetchall(), key=repr) == want


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", 0)
    rows, items = tables(spark)
    assert digest(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = tables(spark)
    assert digest(spark, rows, []) == brute(rows, [])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert op.contamination(documents(spark, rows).where("false"), bench).collect() == []


def test_contaminated_documents_go(spark):
    rows, items = tables(spark)
    docs = documents(spark, rows)
    kept = op.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((b[0] for b in brute(rows, items) if not b[-1]), key=repr)


def test_no_python_on_the_main_path(spark):
    rows, items = tables(spark)
    found = op.digest(op.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
