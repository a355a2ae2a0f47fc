"""Properties of functions and of the store's upkeep, by plain code; awkward rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect import config
from recollect.functions import content
from recollect.functions import text as T
from recollect.operators import assemble, chunks, walks
from recollect.sources import shared

ALPHABET = ["a", "B", " ", "\n", "\r", "\t", "é", "ß", "集", "😀", "_", "-", ".", "/", "9", "　", "́"]


def texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "a\n", "\n\n", *("".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(n))]


def test_text_functions_by_plain_code(spark):
    rows = texts(300, 1)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    found = df.select("id", T.truncate_to_bytes("text", 7).alias("cut"), T.replay_pieces("text", F.lit(5)).alias("pieces"), T.lines_of("text").alias("lines"), T.code_tokens("text").alias("code"), T.folded_tokens("text").alias("folded")).collect()
    for r in found:
        t = rows[r["id"]]
        if t is None:
            assert [r[c] for c in ("cut", "pieces", "lines", "code", "folded")] == [None] * 5
            continue
        assert r["cut"] == t.encode()[:7].decode(errors="ignore")
        assert "".join(r["pieces"]) == t
        assert all(0 < len(p) <= 5 for p in r["pieces"])
        want = t.replace("\r\n", "\n").split("\n")
        assert r["lines"] == (want[:-1] if want[-1] == "" else want)
        assert len(set(r["code"])) == len(r["code"])
        assert all(w == w.lower() for w in r["folded"])


def test_contents(spark):
    rows = ['"a\\nb"', '[{"type":"text","text":"x"},{"type":"image_url"},{"text":null},{"text":5},3]', "[]", "{}", "12", "null", "not json", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, c string")
    got = {r["id"]: r["t"] for r in df.select("id", content.flatten(F.col("c")).alias("t")).collect()}
    assert got == {0: "a\nb", 1: f"x\n{content.IMAGE}\n\n\n", 2: "", 3: "", 4: "", 5: "", 6: "", 7: "", 8: ""}


@pytest.mark.parametrize("seed", range(4))
def test_eviction_by_sorting(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.getrandbits(40):010x}", rng.randrange(400) * (1 if seed < 3 else 10_000)) for _ in range(300)]
    store = spark.createDataFrame([(h, 0, u) for h, u in rows], "content_hash string, ts long, last_used long")
    target, guard = rng.randrange(0, 300), rng.choice([0, 50, 10_000])
    clock = max(u for _, u in rows)
    old = sorted((u, h) for h, u in rows if u < max(0, clock - guard))
    gone = {h for _, h in old[: max(0, 300 - target)]}
    got = {r["content_hash"] for r in chunks.evict(store, target, guard, buckets=4).collect()}
    assert got == {h for h, _ in rows} - gone


def test_positions_of_a_large_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7 % 1000) for i in range(1000)]
    got = {(r["g"], r["o"]): r["pos"] for r in chunks.positions(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()}
    want: dict = {}
    for g in {g for g, _ in rows}:
        want |= {(g, o): k + 1 for k, o in enumerate(sorted(o for h, o in rows if h == g))}
    assert got == want


def test_walks_stop_at_their_bounds(spark):
    """One anchor with twenty names, each in a chunk of its own: no more than the cap, always the same ones."""
    rows = [(1, 0, "anchor names " + " ".join(f"unit{k:02d}" for k in range(20)))] + [(1, k + 1, f"unit{k:02d} is leaf{k}") for k in range(20)]
    rows += [(2, 0, None), (3, 0, "")]
    df = spark.createDataFrame(rows, "scope long, idx long, raw string")
    asked = spark.createDataFrame([(1, "what does anchor name?"), (2, "x"), (3, None)], "scope long, query string")
    for walk in (lambda: walks.follow_rare_words(df, asked, 0.15, 2, 4), lambda: walks.best_first(df, asked, 2, 4), lambda: walks.best_first(df, asked, 2, 4, folded=False)):
        first = sorted((r["rank"], r["idx"]) for r in walk().collect())
        assert first == [(1, 0), (2, 1), (3, 2), (4, 3)]
        assert first == sorted((r["rank"], r["idx"]) for r in walk().collect())


def test_prompts_of_nothing(spark):
    cut = spark.createDataFrame([], "scope long, pos long, sub long, positional_id string, content_hash string, raw string")
    asked = spark.createDataFrame([], "scope long, query string")
    store = spark.createDataFrame([], "content_hash string, summary string")
    assert assemble.recap(cut, asked, store, F.upper).count() == 0
    assert assemble.exhaustive(cut, asked, store, F.upper).count() == 0


def test_overlong_notes_are_digested_again(spark):
    rows = [(1, k, None, str(k), f"h{k}", f"line {k} " * 100) for k in range(1, 30)]
    cut = spark.createDataFrame(rows, "scope long, pos long, sub long, positional_id string, content_hash string, raw string")
    asked = spark.createDataFrame([(1, "q")], "scope long, query string")
    store = spark.createDataFrame([], "content_hash string, summary string")
    digest = lambda t: F.substring(t, 1, 120)
    whole = assemble.exhaustive(cut, asked, store, digest, n_ctx=100_000).first()["system"]
    short = assemble.exhaustive(cut, asked, store, digest, n_ctx=600, max_tokens=100, target=400).first()["system"]
    assert len(short) < len(whole) / 2
    assert "[chunk 1.1]" in short


def test_settings():
    told = config.read({"RECOLLECT_N_CTX": " 4096 ", "RECOLLECT_TRIGGER": "x", "RECOLLECT_ESCALATE": "Off", "RECOLLECT_FENCE_NOTES": "maybe", "RECOLLECT_SEED": " off ", "RECOLLECT_MAX_CHUNKS": "-1", "N_CTX": "1"})
    assert (told.n_ctx, told.trigger, told.escalate, told.fence_notes, told.seed, told.max_chunks) == (4096, 0.9, False, True, "off", 64)
    assert config.read({}) == config.Settings()


def test_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            told = None

            @classmethod
            def get(cls, *_):
                return cls.told

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
    Session.conf.told = "hdfs:///shared"
    assert shared.shared_dir(Session()) == "hdfs:///shared"
