"""Large ids beside nulls, clashing and dotted column names, and executors without the package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from kgspark.llm import jaccard, packing, pii, quality, warc

BIG = (1 << 60) + 1
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_large_ids_of_pages(spark):
    rows = [(BIG + i, "http://a.b/c", ["x", "y", None, "x"][i % 4]) for i in range(12)] + [(None, "http://n/", "x"), (None, None, None), (3, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = warc.read_archives(warc.write_archives(pages), warc.uri_of(warc.shared_root(spark))).collect()
    assert sorted(r["page_id"] or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    top = {h: max(p for p, _, x in rows if p and (x or "") == h) for h in ("x", "y", "", "only")}
    of = {p: x or "" for p, _, x in rows}
    for r in got:
        if r["page_id"] is not None:
            h = of[r["page_id"]]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top[h] else ("revisit", top[h]))


def test_large_ids_of_documents(spark):
    rows = [(BIG, "one two"), (None, "three"), (BIG + 2, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, BIG, BIG + 2]


def test_columns_keep_their_values(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 7, 70, 700, 7000), (2, text, "en", "s", 8, 80, 800, 8000), (2, "alone " + text[20:], "en", "s", 9, 90, 900, 9000)]
    names = ["_key", "text_key", "keep_key", "a.b"]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    left = jaccard.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r["_key"] for r in left.collect()) in ([7], [7, 9])
    assert {tuple(r)[4:] for r in left.collect()} <= {r[4:] for r in rows}
    for step in (quality.keep_good, pii.redact):
        out = step(docs)
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} <= {r[4:] for r in rows}
    again = docs.unionByName(docs.where("doc_id = 1"))
    assert sorted(r["text_key"] for r in jaccard.drop_copies(again).collect() if r["doc_id"] == 1) == [70]


@pytest.mark.parametrize("names", ["op4 op7 op8", "op6 op10 op11 op12 op13", "op2 op5 r1_ r7_ x2_"])
def test_executors_without_the_package(names, tmp_path):
    """Workers get their code with the job: the driver alone has the repository on its path."""
    code = f"""
    import os, sys, tempfile
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r} + "/shared").getOrCreate()
    spark.range(1).count()
    sys.path.insert(0, {REPO!r})
    import __spark_entry__ as entry
    queries = entry.queries()
    for start in {names.split()!r}:
        for name in [n for n in queries if n.startswith(start if start.endswith("_") else start + "_")]:
            queries[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
            print("ran", name)
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = [p for p in sys.path if os.path.exists(os.path.join(p, "public_tokenizers"))]
    env |= {"PYTHONPATH": ":".join(tokenizers)} if tokenizers else {}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") >= len(names.split())
