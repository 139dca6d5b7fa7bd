import random

from panelcast.llm.linededup import dedup_lines


def brute(pairs, width=3):
    """{(id, text): cleaned text} by scanning all windows in order."""
    def order(p):
        return (p[0] is None, p[0] or 0)
    places = {}
    rows = []
    for i, t in pairs:
        lines = t.split("\n") if t is not None else []
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        rows.append((i, t, lines, solid))
        for a in range(len(solid) - width + 1):
            w = tuple(lines[k].strip(" \t\r") for k in solid[a:a + width])
            places.setdefault(w, []).append((*order((i, t)), t, a))
    out = {}
    for i, t, lines, solid in rows:
        cut = set()
        for a in range(len(solid) - width + 1):
            w = tuple(lines[k].strip(" \t\r") for k in solid[a:a + width])
            ids = [p[:2] for p in places[w]]
            mine = (*order((i, t)),)
            # ids are unique in these fixtures, so the order within equal ids is by position
            first = min(ids)
            earlier = [p for p in places[w] if p[:2] == first]
            if mine > first or (mine == first and a > min(p[3] for p in earlier)):
                cut.update(solid[a:a + width])
        out[i, t] = t if not cut else "\n".join(x for k, x in enumerate(lines) if k not in cut)
    return out


def got(df):
    return {(r["doc_id"]): (r["text"], r["__n_removed"], r["__n_lines"]) for r in df.collect()}


def test_matches_brute_force(make_docs):
    rnd = random.Random(1)
    pool = [f"line {k}" for k in range(12)] + ["", "  "]
    pairs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    expected = {i: t for (i, _), t in brute(pairs).items()}
    assert {i: v[0] for i, v in got(dedup_lines(make_docs(pairs))).items()} == expected


def test_overlapping_windows_and_first_occurrence(make_docs):
    out = got(dedup_lines(make_docs(["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "p\nq\nr"])))
    assert out[0] == ("a\nb\nc\nd", 0, 4)
    assert out[1] == ("x\ny", 4, 6)  # two windows merge into four lines
    assert out[2] == ("p\nq\nr", 0, 3)


def test_odd_input(spark, make_docs):
    long = "\n".join(f"w{k}" for k in range(50_000))
    out = got(dedup_lines(make_docs([None, "", "a\nb", "\n\n\n\n\n", "\n\n\n\n\n", " a \nb\t\nc\r", "a\nb\nc", long])))
    assert out[0] == (None, 0, 0) and out[1] == ("", 0, 0) and out[2] == ("a\nb", 0, 2)
    assert out[3][0] == out[4][0] == "\n\n\n\n\n"  # blank lines are no window
    assert out[6] == ("", 3, 3)  # trimmed lines are equal
    assert out[7] == (long, 0, 50_000)
    assert dedup_lines(make_docs(["a"]).limit(0)).count() == 0


def test_repeated_rows_and_missing_ids(spark, make_docs):
    out = [(r["doc_id"], r["text"]) for r in dedup_lines(make_docs([(5, "a\nb\nc"), (5, "a\nb\nc"), (None, "a\nb\nc")])).collect()]
    assert sorted(out, key=str) == [(5, "a\nb\nc"), (5, "a\nb\nc"), (None, "")]


def test_extra_columns_pass_through(spark):
    df = spark.createDataFrame([(0, "a\nb\nc", 7, "k"), (1, "a\nb\nc\nd", 8, None)], "doc_id long, text string, count long, `first` string")
    rows = {r["doc_id"]: r.asDict() for r in dedup_lines(df).collect()}
    assert rows[1]["text"] == "d" and rows[1]["count"] == 8 and rows[0]["first"] == "k"


def test_clashing_columns_pass_through(spark, make_docs):
    body = "one line\ntwo line\nthree line"
    names = ["__key", "__cut", "__lines", "__solid", "__kept", "__cut_id", "__cut_key", "__n_lines"]
    docs = make_docs([body, body, None]).selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    out = {r["doc_id"]: r.asDict() for r in dedup_lines(docs).collect()}
    assert [out[k]["text"] for k in range(3)] == [body, "", None]
    assert all(out[k][n] == i for k in range(3) for i, n in enumerate(names[:-1]))
    assert (out[1]["__n_lines"], out[1]["__n_removed"]) == (3, 3)
