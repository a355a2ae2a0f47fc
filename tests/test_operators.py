"""Edge cases: nulls, blanks, ties, repeats, empty tables; and what SQL does not check."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import chunks, messages, notes, retrieval
from recollect.sources.tables import read_store
from recollect.streaming.ingest import file_stream, keep_store


def fnv(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return f"{h:016x}"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "École 集計 😀", "x" * 3000])
def test_hash(spark, text):
    assert one(spark, T.content_hash(F.lit(text))) == fnv(text)


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("a", 1), ("abcde", 2), ("集計", 2), ("集計ab", 3)])
def test_tokens(spark, text, n):
    assert one(spark, T.est_tokens(F.lit(text).cast("string"))) == n


def test_compound_tokens(spark):
    assert one(spark, T.compound_tokens(F.lit("See a_b-C.d/ end. A_B"))) == ["see", "a_b-c.d", "a", "b", "c", "d", "end", "a_b"]


def test_pieces_are_whole(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word ", "line\n", "集", "\n"]) for _ in range(rng.randrange(400))) for _ in range(40)] + ["x" * 5000, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for text, parts in ((r["text"], r["p"]) for r in df.select("text", chunks.line_pieces("text", 20).alias("p")).collect()):
        assert (parts is None) if text is None else "".join(parts) == text


def test_tails_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "tool"]), "abcd" * rng.randrange(60)) for c in range(40) for t in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sliding = {r["conv_id"]: r["cut"] for r in messages.sliding_tail(df, 80).collect()}
    stepped = {r["conv_id"]: r["cut"] for r in messages.stepped_tail(df, 80, 40).collect()}
    for c in range(40):
        mine = [(r, len(x) // 4) for k, _, r, x in rows if k == c]
        n, sizes = len(mine), [x for _, x in mine]
        cut = n - 1
        while cut > 0 and sum(sizes[cut - 1 :]) <= 80:
            cut -= 1

        def snap(i, mine=mine):
            while i > 0 and mine[i][0] == "tool":
                i -= 1
            return i

        assert sliding[c] == snap(cut)
        best = k = 0
        reached = 0
        while sum(sizes[best:]) > 80 and reached < n:
            k += 1
            reached = next((i for i in range(n) if sum(sizes[:i]) >= k * 40), n)
            best = max(best, snap(min(reached, n - 1)))
        assert stepped[c] == best


def test_store(spark):
    empty = read_store(spark, "/nowhere/at/all")
    assert empty.count() == 0
    calls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "seq long, raw string")
    store = {r["raw"]: (r["ts"], r["hits"], r["last_used"]) for r in chunks.merge(empty, calls).collect()}
    assert store == {"a": (1, 1, 3), "b": (2, 0, 2), "c": (4, 0, 4)}
    left = chunks.evict(chunks.upsert(calls), target=1, guard=0)
    assert [r["raw"] for r in left.collect()] == ["c"]
    assert chunks.evict(chunks.upsert(calls), target=1, guard=100).count() == 3


def test_stream_keeps_the_store(spark, tmp_path):
    source = str(tmp_path / "calls")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq long, raw string").coalesce(1).write.parquet(source)
    keep_store(file_stream(spark, source, "seq long, raw string"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert {r["raw"]: r["hits"] for r in read_store(spark, str(tmp_path / "store" / "version=0")).collect()} == {"a": 1, "b": 0}


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for f in (messages.numbered, messages.last_query, messages.hoist, messages.merge_into_user, lambda m: messages.sliding_tail(m, 9), lambda m: messages.stepped_tail(m, 9, 3)):
        assert f(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "")], "idx long, raw string")
    asked = spark.createDataFrame([(1, "word"), (2, None)], "query_id long, text string")
    assert retrieval.bm25(odd, asked, 3).count() == 0
    assert retrieval.grep(odd, [], 10).count() == 0
    digests = spark.createDataFrame([(1, 1, "1", None), (1, 2, "2", "NONE")], "group_id long, rank long, positional_id string, summary string")
    assert notes.build_notes(digests).first()["notes"] == notes.NOTHING


def test_walk_by_brute_force(spark):
    rng = random.Random(3)
    terms = {(i, f"t{rng.randrange(60)}") for i in range(50) for _ in range(3)}
    df = spark.createDataFrame(sorted(terms), "idx long, term string")
    got = {r["idx"]: r["depth"] for r in retrieval.follow_terms(df, df.filter("idx = 0").select("idx").distinct(), 4, 2).collect()}
    holders: dict[str, set[int]] = {}
    for i, t in terms:
        holders.setdefault(t, set()).add(i)
    want, edge = {0: 0}, {0}
    for hop in (1, 2):
        edge = {j for i, t in terms if i in edge and len(holders[t]) <= 4 for j in holders[t]} - want.keys()
        want |= dict.fromkeys(edge, hop)
    assert got == want


def test_grep_by_brute_force(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["port 80", "a Port", "nothing", "", "集計 line " * 3]) for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, raw string")

    def est(t):
        wide = sum("　" <= c <= "ヿ" or "一" <= c <= "鿿" for c in t)
        return wide - (-(len(t) - wide) // 4)

    want = {}
    for i, text in enumerate(texts):
        lines = text.removesuffix("\n").split("\n")
        hits = {k for k, x in enumerate(lines) if "port" in x.lower()}
        out, last = "", None
        for k in sorted(hits | {k + 1 for k in hits if k + 1 < len(lines)}):
            out += ("…\n" if last is not None and k > last + 1 else "") + lines[k] + "\n"
            last = k
            if est(out) > 20:
                break
        out = out.rstrip()
        if hits:
            want[i] = out if len(out) <= 80 else out[:80] + T.CUT_MARK
    assert {r["idx"]: r["found"] for r in retrieval.grep(df, ["port"], 20).collect()} == want


def test_hashed_bag_by_brute_force(spark):
    texts = ["a b a", "École x_1 X_1", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {}
    for i, words in enumerate((["a", "b", "a"], ["École", "x_1", "x_1"])):
        counts: dict[int, int] = {}
        for w in words:
            k = int(fnv(w), 16) % 256
            counts[k] = counts.get(k, 0) + 1
        norm = sum(x * x for x in counts.values()) ** 0.5
        want |= {(i, k): pytest.approx(x / norm) for k, x in counts.items()}
    assert {(r["id"], r["bucket"]): r["value"] for r in retrieval.hashed_bag(df, T.word_tokens("text"), "id").collect()} == want
