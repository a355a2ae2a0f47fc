"""Operators that SQL cannot express, against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("recollect.llm.queries")

from recollect.llm import language_id, ngram_join, packing, quality, sentencepieces, token_orc  # noqa: E402
from recollect.llm.embedding_dedup import near_duplicates as near_vectors  # noqa: E402
from recollect.llm.html_extract import extract_pages  # noqa: E402
from recollect.llm.lm_score import score_documents  # noqa: E402
from recollect.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(words, k=60))
    texts: list[str | None] = [None, "", "   ", "one two", "One two", "ab"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(40, 160))
        for _ in range(rng.randrange(1, 6)):
            copy = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(copy) + (" " + shared if rng.random() < 0.3 else ""))
    texts += ["hot " * 5 + " ".join(words[:80]) + f" end{i}" for i in range(90)]
    rng.shuffle(texts)
    return [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, words, num):
    rows = corpus()
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), words, num, 100, common=8, chunk=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    vectors: list[list[float] | None] = [None, [], [0.0] * 64, [float("nan")] * 64]
    for _ in range(20):
        base = rng.normal(size=64)
        vectors += [(base + rng.normal(size=64) * s).tolist() for s in rng.uniform(0, 0.4, size=6)]
    vectors += [vectors[4]] * 3
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    unit = {}
    for i, v in enumerate(vectors):
        x = np.array(v, np.float32).astype(np.float64) if v else np.zeros(1)
        if np.isfinite(x).all() and (x != 0).any():
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    count: dict[int, int] = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = roots(range(len(vectors)), links)
    got = near_vectors(df, threshold=0.95).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (count[i], want[i], want[i] == i) for i in range(len(vectors))}


TEXTS = [None, "", " ", "Hello world", "École 集計 😀\n\ttabs", "<s></s>▁ x", "a" * 3000, "\u0000 ​", "it's 1,234.5 o'clock " * 200, "<|endoftext|> é"]


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    for r in sentencepieces.encode_documents(df, path, digests_only=True).collect():
        ids = lib.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def byte_ids(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in TEXTS]


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    path = str(tmp_path / "orc")
    token_orc.write(df, path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    start = 0
    for r, ids in zip(sorted(token_orc.positions(token_orc.read(spark, path)).collect(), key=lambda r: r["doc_id"]), byte_ids(2), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_registered_queries_keep_the_library_default(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from recollect.llm.queries import QUERIES

    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    assert 50256 in ids[-1]
    start = 0
    for r, own in zip(sorted(QUERIES["op7_token_orc"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"]), ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes()))
        start += len(own) + 1
    for rows in (QUERIES["op10_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, df, str(tmp_path))):
        assert check_packing(rows.collect(), 2048)[0] == {i: len(own) + 1 for i, own in enumerate(ids)}


def check_packing(rows, capacity):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(found)):
            assert (piece, start) == (k, at)
            assert length == capacity or k == 0
            at += length
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return {k: sum(x[2] for x in v) for k, v in pieces.items()}, len(places)


def test_packing(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    rows = packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), capacity=64).collect()
    lengths, n = check_packing(rows, 64)
    want = {i: len(ids) for i, ids in enumerate(byte_ids(0))}
    assert lengths == want
    assert n <= -(-sum(want.values()) // 64) + 2


def test_quality_base(spark):
    rows = [*corpus(), (900, "x y x\n\nx y x\nq # <", None, None, None), (901, "a b c " * 40, "en", None, None)]
    for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams: dict[tuple, list[int]] = defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        repeated = {k + d for at in grams.values() if len(at) > 1 for k in at for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    found = language_id.predict(docs, model).join(docs, "doc_id").filter("doc_id % 2 = 1 AND lang IS NOT NULL")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_extraction(spark):
    body = "".join(f"<p>The {w} paragraph of the article says a good deal about rivers &amp; hills, at some length, in full sentences.</p>" for w in ("first", "second", "third"))
    html = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Rivers</h1>{body}</article><script>x()</script><footer>Copyright</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert (found[2]["text"], found[2]["n_chars"], found[3]["text"]) == ("", 0, "")
    text = found[1]["text"]
    assert "rivers & hills" in text
    assert not re.search("Home|Copyright|x\\(\\)|p\\{", text)
    assert found[1]["n_chars"] == len(text)


BODY = "".join(f"<p>The {w} paragraph of the article says a good deal about rivers &amp; hills, in full.</p>" for w in ("first", "second", "third"))
SAYS = "\n\n".join(f"The {w} paragraph of the article says a good deal about rivers & hills, in full." for w in ("first", "second", "third"))
#: Pages, and their main text.
PAGES = [
    (f'<nav><a>Home</a></nav><div class="content has-sidebar">{BODY}</div><div class="sidebar"><p>Buy our things now, they are good.</p></div>', SAYS),
    (f'<article class="post tag-legal">{BODY}</article><footer>Copyright 2020</footer>', SAYS),
    (f'<div class="article"><div class="article-header"><h1>Rivers</h1></div>{BODY}</div>', "Rivers\n\n" + SAYS),
    (f'<article>{BODY}<p class="more">This one is a full sentence too, as it says a lot of things.</p></article>', SAYS + "\n\nThis one is a full sentence too, as it says a lot of things."),
    (f'<div data-x="not hidden ">{BODY}</div>', SAYS),
    (f"<div>{BODY}</div><div hidden><p>Secret text that nobody is to see here, at all.</p></div>", SAYS),
    (f'<div>{BODY}</div><div style="display: none"><p>Secret text that nobody is to see here, at all.</p></div>', SAYS),
    (f"<select><option>one<option>two<div>{BODY}</div>", SAYS),
    (f"<canvas><div>{BODY}</div>", SAYS),
    (f"<title>Rivers<body><div>{BODY}</div>", SAYS),
    (f"<div>{BODY}</div><script>var x = '<p>no text of the page, this is</p>'", SAYS),
    ("<article><p>The sum <math><mi>x</mi>+<mi>y</mi></math> is positive, as one can see at once.</p></article>", "The sum x+y is positive, as one can see at once."),
    (f'<article>{BODY}</article><div class="comments"><article class="comment"><p>I think that this is a very good article, thank you for it.</p></article></div>', SAYS),
    (f'<div class="post">{BODY}</div><section id="post-comments"><p>I think that this is a very good article, thank you for it.</p></section>', SAYS),
    (f'<div class="cookie-notice"><p>We use cookies to make this site better for you. Do you agree?</p></div><div id="main">{BODY}</div>', SAYS),
    (f'<div class="ad-slot"><p>Buy our things now, they are good and cheap.</p></div><div class="entry-content">{BODY}<div class="share">Share this</div></div>', SAYS),
    (f"<form><p>Enter your address here, and we write to you each week.</p></form>{BODY}", SAYS),
    ("<div>" * 30_000 + BODY, SAYS),
    ("<p>" + "word " * 300_000 + "end.</p>", ("word " * 300_000) + "end."),
    ("<svg>" * 20_000 + "<title>x" * 20_000 + "</span>" * 20_000, ""),
]


def test_extraction_of_many_kinds(spark):
    import time

    df = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    start = time.time()
    found = {r["page_id"]: r["text"] for r in extract_pages(df).collect()}
    assert time.time() - start < 30
    for i, (page, want) in enumerate(PAGES):
        assert found[i] == want, page[:200]


def test_extraction_weights_from_labels():
    """Weights fitted to labelled blocks tell them apart where those that are set do not."""
    from recollect.llm import html_extract

    blocks, content = [], []
    for k in range(30):
        page = html_extract.read(f"<div><p>{'Buy this now. ' * (k + 5)}</p></div><article><p>Short {k}</p><p>no end {k}</p></article>")
        blocks += page.blocks
        content += [False, True, True]
    weights = html_extract.fit(blocks, content, ridge=0.01)
    assert [html_extract.score(b) > 0 for b in blocks] != content
    assert [html_extract.score(b, weights) > 0 for b in blocks] == content


def test_minimum_cut_against_all_labellings():
    from itertools import product

    from recollect.llm.html_extract import min_cut

    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 9)
        scores = [rng.randrange(-4000, 4000) / 1000 for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 2000) / 1000) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(kept, scores=scores, edges=edges):
            return sum(max(0, z) if not k else max(0, -z) for z, k in zip(scores, kept, strict=True)) + sum(w for a, b, w in edges if kept[a] != kept[b])

        assert cost(min_cut(scores, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_scoring_base(spark):
    import math

    from pyspark.sql import functions as F

    rows = corpus()[:60]
    told = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t, *_ in rows}
    counts: dict = defaultdict(int)
    for i, w in told.items():
        if i % 3:
            for x in w:
                counts[x] += 1
    n, v = sum(counts.values()), len(counts)
    for r in score_documents(spark.createDataFrame(rows, DOCS), F.col("doc_id") % 3 != 0).collect():
        w = told[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts.get(x, 0) > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r["score"] <= 0


def test_scoring_many_contexts(spark):
    """The statistics hold every context: words once seen are known from their first unlike letters on."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["%012x" % rng.getrandbits(48) for _ in range(200_000)]
    rows = [(i, " ".join(words[i::200]), None, None, None) for i in range(200)]
    found = score_documents(spark.createDataFrame(rows, DOCS), F.lit(True)).agg(F.sum("score"), F.sum("n_bytes")).first()
    assert -found[0] / np.log10(2) / found[1] < 2.2


def test_scoring_word_order(spark):
    """Held-out texts score higher than the same words shuffled."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    after = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(3)] for i in range(300)}

    def chain():
        told = ["w0"]
        while len(told) < 100:
            told.append(rng.choice(after[told[-1]]))
        return told

    rows = [(i, " ".join(chain()), None, None, None) for i in range(300)]
    held = [chain() for _ in range(20)]
    rows += [(300 + i, " ".join(t), None, None, None) for i, t in enumerate(held)]
    rows += [(400 + i, " ".join(rng.sample(t, len(t))), None, None, None) for i, t in enumerate(held)]
    found = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(rows, DOCS), F.col("doc_id") < 300).collect()}
    assert all(found[300 + i] > 0.8 * found[400 + i] for i in range(20))


def plain_scores(rows, trainable, common, code):
    """The model's log10 probabilities, decision by decision with dictionaries; the code of the tokens is given."""
    import math

    from recollect.llm import lm_score as lm

    def number_of(w):
        h = int(lm.Texts([w.decode()]).hashes[0]) if w else int(lm.END)
        return int(code.find(np.array([h], np.uint64))[0][0]), h

    def path(number):
        return format(int(code.left[number]), f"0{lm.CODE_BITS}b")[: int(code.length[number])]

    docs = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""] for i, t in rows}
    count: dict = defaultdict(int)
    node: dict = defaultdict(int)
    under: dict = defaultdict(set)
    contexts = {}
    for i, tokens in docs.items():
        for k, w in enumerate(tokens):
            number, _ = number_of(w)
            at = [(1, tokens[k - 1] if k else None), (2, tokens[k - 1] if k else None, tokens[k - 2] if k > 1 else None)]
            contexts[i, k] = at
            count[w] += trainable(i)
            for c in at:
                for d in range(len(path(number)) + 1):
                    node[c, path(number)[:d]] += trainable(i)
                    under[c, path(number)[:d]].add(number)
    alone = lm.alone_table()
    out = {}
    for i, tokens in docs.items():
        weights = lm.START_WEIGHTS.astype(float).copy()
        hits = np.full(lm.BUCKETS, 64.0)
        came = hits / (1 + np.exp(-(np.arange(lm.BUCKETS) + 0.5) / 2))
        total = 0.0
        for lo in range(0, len(tokens), lm.WINDOW):
            error, seen, map_now = np.zeros_like(weights), np.zeros(lm.GATES), came / hits
            for k in range(lo, min(lo + lm.WINDOW, len(tokens))):
                w = tokens[k]
                number, h = number_of(w)
                p, unseen = path(number), count[w] == 0
                for d in range(code.escape + 1 if unseen else len(p)):
                    first = int(code.base[code.begin[number] + d])
                    x = [first]
                    for c in contexts[i, k]:
                        prior = lm.PRIOR[c[0] - 1]
                        whole, part = node[c, p[:d]], node[c, p[: d + 1]]
                        if whole < lm.ENOUGH[c[0] - 1]:
                            x.append(first)
                        elif len(under[c, p[:d]]) == 1:
                            x.append(int(alone[c[0] - 1][min(255, whole)][first + 128]))
                        else:
                            q = prior * lm.CHANCE[first + 128]
                            x.append(int(lm.widened(lm.narrowed(np.log((part + q) / (whole - part + prior - q)), np.int8(first)), np.int8(first))))
                    x = np.array(x) / lm.SCALE * (-1 if unseen and d == code.escape else 1)
                    gate = 3 * sum(round(abs(x[1]) * lm.SCALE) > round(s * lm.SCALE) for s in lm.SURE) + sum(round(abs(x[2]) * lm.SCALE) > round(s * lm.SCALE) for s in lm.SURE)
                    z = float(np.clip(weights[gate] @ x, -lm.MOST, lm.MOST))
                    chance = 1 / (1 + math.exp(-z))
                    cell = int(abs(z) * 2)
                    total += math.log(0.75 * chance + 0.25 * (map_now[cell] if z > 0 else 1 - map_now[cell] if z < 0 else 0.5))
                    error[gate] += (1 - chance) * x
                    seen[gate] += 1
                    hits[cell] += z != 0
                    came[cell] += z > 0
                if unseen:
                    total += float(code.spell([w])[0])
                elif number > code.unseen and number <= code.unseen + lm.RARE:
                    total += math.log(count[w] / code.rare[number - code.unseen - 1])
            weights += 0.1 * error / np.sqrt(np.maximum(seen, 1))[:, None]
        out[i] = total / math.log(10)
    return out


def test_scoring_against_plain_coder(spark):
    from pyspark.sql import functions as F

    from recollect.llm import lm_score

    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 50))) for _ in range(40)]
    texts += [None, "", "é Ünseen WORDS never\tthere", texts[0], texts[0].upper(), "w1 " * 300]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    code, total, distinct, _ = lm_score.fit(df.withColumn("train", F.expr("doc_id % 4 <> 1")), 3, common=20)
    assert 0 < len(code.hashes) <= 20 < distinct < total
    want = plain_scores(rows, lambda i: i % 4 != 1, 20, code)
    got = {r["doc_id"]: r["score"] for r in score_documents(df, F.col("doc_id") % 4 != 1, common=20, block_bytes=500).collect()}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-3, abs=1e-3), i


def test_scoring_code_is_a_probability():
    """Over all tokens of a code, the first predictor's probabilities add up to one."""
    from recollect.llm import lm_score as lm

    rng = np.random.default_rng(3)
    code = lm.Code(rng.integers(0, 1 << 63, 200).astype(np.uint64), rng.integers(1, 1000, 200), rng.integers(0, 3, lm.RARE).astype(float), 50, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    p = 1 / (1 + np.exp(-code.base / lm.SCALE))
    assert np.exp(np.add.reduceat(np.log(p), code.begin)).sum() == pytest.approx(1, abs=0.05)
    assert np.exp(code.spell([bytes([a]) for a in range(33, 256)] + [b""])).sum() <= 1


def test_pipeline_and_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= before
        before = kept
    lengths, _ = check_packing(pipeline.run(spark, folder).collect(), 2048)
    assert set(lengths) == before


def test_pipeline_decides_by_row(spark):
    """Rows of one id with unlike texts, rows without an id, repeated rows and columns of any name."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    near = texts[0].replace(texts[0].split()[40], "other", 1)
    rows = [(1, texts[0], 1), (1, texts[1], 2), (1, texts[1], 2), (None, texts[2], 3), (None, texts[2], 3), (5, texts[3], 4), (7, near, 5), (3, texts[3] + " end", 6), (8, None, 7), (9, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth int").selectExpr("*", "'en' AS lang", "1 AS _key", "2 AS ok")
    found = pipeline.drop_near_duplicates(spark, df, "")
    assert found.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found.collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (3, texts[3] + " end"), (8, ""), (9, ""), (0, "")])
    for stage in (pipeline.identify_language, pipeline.apply_quality_rules):
        assert stage(spark, df, "").columns == df.columns
    assert {r["text"] for r in pipeline.identify_language(spark, df, "").collect()} == {*texts[:4], near, texts[3] + " end"}
    assert {r["text"] for r in pipeline.identify_language(spark, df.drop("lang").selectExpr("*", "cast(null AS string) AS lang"), "").collect()} >= set(texts[:4])


def test_language_left_out(spark):
    """Texts in a language that was not learned are claimed by no machine, as a rule; those of learned languages are."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND size(split(text, ' ')) >= 50")
    model = language_id.fit(docs, (F.col("lang") != "fr") & (F.col("doc_id") % 2 == 0))
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    share = {r["other"]: r["share"] for r in found.filter("doc_id % 2 = 1 OR lang = 'fr'").groupBy((F.col("lang") == "fr").alias("other")).agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()}
    assert share[False] > 0.99
    assert share[True] < 0.1


def test_hot_template(spark):
    """Copies of a template, more than a chunk of them, with a stranger among them for one shingle: one class, and one more."""
    words = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"own{i}"]), "en", "a", 0) for i in range(120)]
    rows += [(500 + i, " ".join([*words[:8], *(f"x{i}y{j}" for j in range(40))]), "en", "a", 0) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85, 100, common=4, chunk=16).collect()}
    assert got == {i: 0 if i < 120 else i for i, *_ in rows}


def test_vectors_of_doubles(spark):
    """Doubles are compared as doubles, beyond what floats hold, and rows of one id keep their own vectors."""
    a, b = np.cos(0.3175), np.sin(0.3175)  # cosines of 0.95 lie at an angle of 0.31756 from the first
    rows = [(1, [1.0, 0.0]), (2, [a, b]), (3, [1e300, 0.0]), (4, [np.cos(0.3176), np.sin(0.3176)]), (5, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [-2.0, 0.0]), (None, [1.0, 0.0])]
    found = near_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"), threshold=0.95).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in found if r["vec_id"])
    assert got == [(1, 2, 1), (2, 3, 1), (3, 2, 1), (4, 1, 1), (5, 0, 5), (5, 1, 5), (6, 1, 5)]
