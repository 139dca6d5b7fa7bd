import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import decontaminate
from test_linededup import brute as brute_lines
from test_mixing import poisson
from test_quality import brute as brute_counts
from test_simhash import brute_components, brute_fingerprint

ROOT = Path(__file__).resolve().parents[2]


def write_tables(spark, folder, words):
    base = words(120, 1)
    texts = {i: "\n".join(words(20, 100 * i + k) for k in range(4)) for i in range(40)}
    texts[40] = texts[3]  # an exact copy
    texts[41] = texts[5].replace("\n", " ")  # the same words in one line: only SimHash sees it
    texts[42] = words(30, 7)  # too short
    texts[43] = words(70, 8) + " " + base
    texts[44] = words(20, 9) + "\n" + texts[6] + "\n" + words(60, 10)  # a passage of document 6
    texts[45], texts[46] = None, ""
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, base)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: (t, f"s{i % 3}") for i, t in texts.items()}, base


def test_run_matches_brute_force(spark, tmp_path, words):
    docs, item = write_tables(spark, tmp_path, words)
    good = {}
    for i, (t, s) in docs.items():
        n_words, _, _, _, repeats = brute_counts(t)
        if n_words >= 50 and 100 * repeats <= 50 * n_words:
            good[i] = t
    lines = {i: t for (i, _), t in brute_lines(list(good.items())).items()}
    lines = {i: t for i, t in lines.items() if t != ""}
    ids = sorted(lines)
    roots = brute_components([brute_fingerprint(lines[i]) for i in ids])
    first = [i for k, i in enumerate(ids) if roots[k] == k]
    ws = item.split()
    wins = {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)}

    def leaks(t):
        x = t.lower().split()
        return len(wins & {tuple(x[k:k + 5]) for k in range(len(x) - 4)}) >= 0.8 * len(wins)
    clean = [i for i in first if not leaks(lines[i])]
    assert {40, 41, 42, 43, 45, 46}.isdisjoint(clean) and 44 in clean and len(clean) == 41
    size = Counter()
    for i in clean:
        size[docs[i][1]] += len(lines[i])
    weight = {s: n ** 0.5 for s, n in size.items()}
    rate = {s: sum(size.values()) * weight[s] / sum(weight.values()) / size[s] for s in size}
    expected = Counter({(i, lines[i], len(lines[i])): n for i in clean if (n := poisson(rate[docs[i][1]], i))})
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == expected


def test_stages_keep_the_columns_of_documents(spark, tmp_path, words):
    write_tables(spark, tmp_path, words)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and decontaminate.WINDOW == 5


def test_clashing_columns_and_rows_without_id(spark, tmp_path, words):
    write_tables(spark, tmp_path, words)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = ["__m", "__key", "__id", "__text", "__stratum", "__cut", "__row", "__kept", "__n"]
    odd = docs.selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)]).withColumn(
        "doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, str(tmp_path))
        rows = odd.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports when corpus_pipeline.py and the llm folders are gone; other import errors are not swallowed."""
    for name in ("__spark_entry__.py", "panelcast"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    copy = tmp_path / "panelcast"
    copy.mkdir()
    for p in (ROOT / "panelcast").iterdir():
        if p.name != "llm":
            (copy / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == "[]", done.stderr
