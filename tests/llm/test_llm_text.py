"""Operators over texts, held against brute force, round trips and held-out cases on small fixtures."""

import base64
import gzip
import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlebed.llm import bpe, exact_dedup, html_extract, lm, minhash, mixing, quality, sharding, warc
from needlebed.llm.words import word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=random.Random(i).randint(2, 8))) for i in range(400)]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choices(WORDS, k=n))


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


# Exact dedup.


def test_exact_dedup_keeps_the_smallest_id_and_appends(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = docs_of(spark, ["a", "b", "a", "", "", None, None])
    assert ids(exact_dedup.exact_dedup(first, index)) == [0, 1, 3, 5, 6]
    second = docs_of(spark, ["c", "a", "c", ""])
    assert ids(exact_dedup.exact_dedup(second, index)) == [0]
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=99)
    assert again.buckets == 4 and again.rows().count() == 4
    assert ids(exact_dedup.exact_dedup(docs_of(spark, ["b", "d"]), again)) == [1]


def test_exact_dedup_batch_is_idempotent(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    docs = docs_of(spark, ["x", "y", "x"])
    assert ids(exact_dedup.exact_dedup(docs, index, batch="one")) == ids(exact_dedup.exact_dedup(docs, index, batch="one")) == [0, 1]
    plan = docs.select(exact_dedup.text_digest().alias("digest")).join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_dedup_loses_nothing_when_a_batch_broke_off(spark, tmp_path, monkeypatch):
    """A run that wrote a part of its digests, or all, and died before the log entry; then the batch again, and others."""
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    docs, log = docs_of(spark, [f"t{i}" for i in range(20)]), exact_dedup.DigestIndex._log

    def dies(self, version, state):
        raise KeyboardInterrupt

    for some in (docs.limit(5), docs):
        monkeypatch.setattr(exact_dedup.DigestIndex, "_log", dies)
        with pytest.raises(KeyboardInterrupt):
            exact_dedup.exact_dedup(some, index, batch="one")
        monkeypatch.setattr(exact_dedup.DigestIndex, "_log", log)
    assert index.rows().count() == 0
    assert ids(exact_dedup.exact_dedup(docs, index, batch="one")) == list(range(20)) == ids(exact_dedup.exact_dedup(docs, index, batch="one"))
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    assert ids(exact_dedup.exact_dedup(docs_of(spark, ["t3", "new"]), again, batch="two")) == [1]


def test_exact_dedup_reads_the_parts_of_its_batch_and_compacts(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    for name, texts in (("one", ["a", "b"]), ("two", ["b", "c"]), ("three", ["d"])):
        exact_dedup.exact_dedup(docs_of(spark, texts), index, batch=name)
    text = plan(index._rows(index._state(), "two"))
    assert "PartitionFilters: [" in text and "part#" in text.split("PartitionFilters: [")[1].split("]")[0]
    before = sorted(map(tuple, index.rows().collect()))
    index.compact()
    assert sorted(map(tuple, index.rows().collect())) == before and len(set(index._state()["batches"].values())) == 1
    assert ids(exact_dedup.exact_dedup(docs_of(spark, ["b", "c"]), index, batch="two")) == [1]
    assert ids(exact_dedup.exact_dedup(docs_of(spark, ["d", "e"]), index, batch="four")) == [1]


def test_exact_dedup_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(1, "t", 5), (1, "t", 5), (1, "t", 4), (None, "u", 1), (None, "u", 1), (7, "u", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest int").withColumn("rn", F.lit("r")).withColumn("ID_KEY", F.lit(0))
    got = exact_dedup.exact_dedup(df)
    assert got.columns == df.columns and sorted(map(tuple, got.select("doc_id", "text", "digest").collect())) == [(1, "t", 4), (7, "u", 1)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# Near dedup.


def edited(text, seed, n):
    words, rnd = text.split(), random.Random(seed)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def brute_groups(texts, threshold=minhash.THRESHOLD):
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in words]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted({top(i) for i in range(len(texts))})


def test_near_dedup_against_brute_force(spark):
    texts = [prose(i, 40 + 7 * (i % 20)) for i in range(60)]
    shared = prose(999, 60)
    texts += [shared + " " + prose(2000 + i, 300) for i in range(40)]
    for base in range(12):
        texts += [edited(texts[base], 31 * base + v, 2 + v) for v in range(3 + base % 4)]
    texts += [edited(texts[20], 5000 + v, 5) for v in range(50)]
    texts += [texts[3].upper(), texts[4].replace(" ", "\n"), "", None, "  ", "one", "one", "one two"]
    random.Random(5).shuffle(texts)
    got = ids(minhash.near_dedup(docs_of(spark, texts)))
    want = brute_groups(texts)
    assert got == want
    assert all(i in got for i, t in enumerate(texts) if not (t or "").split())


def test_near_dedup_in_parts(spark, monkeypatch):
    """Groups of more members than are compared at once."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "PAIRS", 5)
    texts = [edited(prose(b, 120), 77 * b + v, 18) for b in range(4) for v in range(14)]
    assert ids(minhash.near_dedup(docs_of(spark, texts))) == brute_groups(texts)


def test_near_dedup_tiles_link_groups_that_no_hub_joins(spark):
    """A chain: neighbours are alike, the ends aren't."""
    words, texts = prose(1, 200).split(), []
    for _ in range(12):
        texts.append(" ".join(words))
        words = words[25:] + prose(len(texts) + 70, 25).split()
    assert brute_groups(texts) == [0] == ids(minhash.near_dedup(docs_of(spark, texts)))


def test_near_dedup_compares_what_can_pass_only(spark):
    """Of documents from stock passages, all pairs over the threshold are candidates; a long one isn't held against short ones."""
    rnd, stock = random.Random(8), [prose(100 + i, 20) for i in range(30)]
    texts = [" ".join(rnd.sample(stock, 8)) for _ in range(60)] + [" ".join(stock[:3]) + f" x{i}" for i in range(6)] + [" ".join(stock)]
    rows = minhash.sketches(docs_of(spark, texts), "doc_id", "text", 3, 64).cache()
    least = 0.5 - 3 * (0.25 / 64) ** 0.5
    lists = minhash.candidate_lists(rows.select("eid", "sketch"), least)
    units = rows.select("eid", "size", F.col("eid").alias("c"), F.col("eid").alias("u"))
    of = {r.eid: r.id for r in rows.collect()}
    got = {tuple(sorted((of[r.ua], of[r.ub]))) for r in minhash._apart(lists, units, 64, least, 0.5).collect()}
    sets = minhash.shingle_sets(texts)
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if minhash.jaccard(sets[i], sets[j]) >= 0.5}
    assert alike <= got and len(alike) > 15
    assert not [p for p in got if len(sets[p[0]]) < 0.5 * len(sets[p[1]]) or len(sets[p[1]]) < 0.5 * len(sets[p[0]])]


def test_near_dedup_leaves_out_pairs_that_share_a_shingle_or_two(spark):
    """Candidates don't grow with the square of the documents that share a short phrase."""
    n_pairs = []
    for n in (60, 120):
        texts = [prose(300 + i, 40) + f" {i} in any case this {i}" for i in range(n)]
        rows = minhash.sketches(docs_of(spark, texts), "doc_id", "text", 3, 64).cache()
        units = rows.select("eid", "size", F.col("eid").alias("c"), F.col("eid").alias("u"))
        n_pairs.append(minhash._apart(minhash.candidate_lists(rows.select("eid", "sketch"), 0.3125), units, 64, 0.3125, 0.5).count())
    assert n_pairs == [0, 0]


def test_near_dedup_edges(spark):
    a = prose(3, 50)
    rows = [(5, a), (5, a), (None, a), (2, edited(a, 1, 2)), (2, "unlike"), (9, "the end"), (9, "the end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("near_key", F.lit(1)).withColumn("th", F.lit(2)).withColumn("EID", F.lit(3))
    got = minhash.near_dedup(df)
    assert got.columns == df.columns and sorted(r[0] for r in got.select("doc_id").collect()) == [2, 2, 9]
    assert minhash.near_dedup(df.limit(0)).count() == 0
    one = spark.createDataFrame([(5, a), (5, a)], "doc_id bigint, text string")
    assert minhash.near_dedup(one).count() == 1


def test_sketch_estimate_is_exact_for_small_sets_and_near_for_large():
    a, b = np.arange(0, 30), np.arange(10, 40)
    assert minhash.union_estimate(a, b) == minhash.jaccard(a, b) == 0.5
    x, y = (minhash.shingle_sets([t])[0] for t in (prose(1, 5000), edited(prose(1, 5000), 2, 500)))
    assert abs(minhash.union_estimate(x[:64], y[:64]) - minhash.jaccard(x, y)) < 0.25


def test_batched_estimates_are_the_single_ones():
    rnd, k = np.random.default_rng(3), 16
    rows = [np.unique(rnd.integers(0, 40, rnd.integers(1, 30)))[:k] for _ in range(200)]
    full = np.full((200, k), minhash.NONE)
    for i, r in enumerate(rows):
        full[i, : len(r)] = r
    got = minhash.estimates(full[:100], full[100:], k)
    assert np.allclose(got, [minhash.union_estimate(a, b, k) for a, b in zip(rows[:100], rows[100:])])


def test_shingles_ignore_case_and_blanks_and_take_long_words():
    a, b = minhash.shingle_sets(["A b\tc  D", "a B\nC d "])
    assert len(a) == 2 and (a == b).all()
    long = minhash.shingle_sets(["x" * 300_000 + " y z", "", "q"])
    assert [len(s) for s in long] == [1, 0, 1]
    word, starts = word_hashes(["a b", "", "b"])
    assert starts.tolist() == [0, 2, 2, 3] and word[1] == word[2] != word[0]


# Mixing.


@pytest.mark.parametrize("seed", range(40))
def test_fit_against_brute_force(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(1, 40), rnd.randint(1, 6)))
    counts = [rnd.randint(1, 5) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    budget = rnd.randint(0, total + 5)
    take, got = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts)) and got == sum(n * t for n, t in zip(lengths, take)) <= budget
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    best = max(s for s in sums if s <= budget)
    assert best - got < min(lengths) or best - got <= max(lengths) // 2


def test_fit_reaches_any_budget_that_mixed_lengths_allow():
    lengths, counts = list(range(1, 300)), [3] * 299
    for budget in (1, 17, 5000, 100_003):
        assert mixing.fit(lengths, counts, budget)[1] == budget


def test_mix_hits_the_weights_exactly(spark):
    texts = [" ".join("w" * (1 + i % 23)) for i in range(900)]
    df = docs_of(spark, texts, ["abc"[i % 3] for i in range(900)])
    got = mixing.mix_sources(df, {"a": 2.0}, budget=2000, tokens_out="n")
    sums = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum("n")).collect()}
    assert sums == {"a": 1000, "b": 500, "c": 500}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_sources(df.repartition(7), {"a": 2.0}, budget=2000, tokens_out="n").collect()))
    other = mixing.mix_sources(df, {"a": 2.0}, budget=2000, seed=99)
    assert ids(other) != ids(got) and other.columns == df.columns
    largest = mixing.mix_sources(df, {"a": 2.0}, tokens_out="n").groupBy("source").agg(F.sum("n").alias("n"))
    has = {s: sum(len(t.split()) for t, i in zip(texts, range(900)) if "abc"[i % 3] == s) for s in "abc"}
    assert {r[0]: r[1] for r in largest.collect()}["a"] in (has["a"], has["a"] - 1)


def test_mix_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, "", "x"), (3, None, "x"), (4, " \n", "x"), (None, "c d", "x"), (5, "e", "gone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(7)).withColumn("mix_rn", F.lit(0))
    got = mixing.mix_sources(df, {"gone": 0.0}, budget=4)
    assert got.columns == df.columns and Counter((r[0], r[2]) for r in got.collect()) == {(1, None): 1, (None, "x"): 1}
    assert mixing.mix_sources(df.limit(0)).count() == 0


# WARC.


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}" if i % 5 else None, "ä" * (i % 3) + prose(i, i)) for i in range(60)] + [(60, "http://x/\r\nb", ""), (61, "u", None), (7, "again", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    files = warc.write_monolithic(pages, f"file://{tmp_path}/whole").collect()
    assert sum(r["records"] for r in files) == 62
    index = warc.normalise(spark.createDataFrame(files), f"file://{tmp_path}/members")
    got = Counter((r["record_id"], r["target_uri"], bytes(r["block"]).decode()) for r in warc.read_records(index).collect())
    assert got == Counter((f"urn:page:{i}", u.replace("\r\n", "%0D%0A") if u else None, h) for i, u, h in rows if h is not None)
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            member = f.read(r["length"])
        assert gzip.decompress(member).startswith(b"WARC/1.0\r\n")
    assert warc.normalise(spark.createDataFrame([], "file string"), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("form", ["one stream", "members", "plain", "cut off"])
def test_warc_streams(form):
    records = [warc.record_head(f"urn:{i}", f"u{i}", len(b)) + b + b"\r\n\r\n" for i, b in enumerate([b"", b"abc\r\n\r\nWARC/1.0\r\n", bytes(range(256)) * 9000])]
    whole = b"".join(records)
    data = {"one stream": gzip.compress(whole), "members": b"".join(map(gzip.compress, records)), "plain": whole, "cut off": gzip.compress(whole)[:-4000]}[form]
    out = io.BytesIO()
    index = warc.normalise_stream(io.BytesIO(data), out, "f")
    parts = [gzip.decompress(out.getvalue()[r["offset"] : r["offset"] + r["length"]]) for r in index]
    assert parts == (records[:2] if form == "cut off" else records)


def test_warc_passes_over_damaged_headers():
    good = [warc.record_head(f"urn:{i}", "u", 3) + b"abc\r\n\r\n" for i in range(3)]
    bad = [b"no header\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\nbody\r\n", b"WARC/1.0\r\nContent-Length: -4\r\n\r\nbody\r\n", b"WARC/1.0\r\nContent-Length: four\r\n", b"x" * 3_000_000 + b"\n"]
    data = bad[0] + good[0] + bad[1] + bad[2] + good[1] + bad[3] + good[2] + bad[4] + b"WARC/1.0\r\nContent-Len"
    out = io.BytesIO()
    index = warc.normalise_stream(io.BytesIO(gzip.compress(data)), out, "f")
    assert [r["record_id"] for r in index] == ["urn:0", "urn:1", "urn:2"]
    assert [gzip.decompress(out.getvalue()[r["offset"] : r["offset"] + r["length"]]) for r in index] == good
    assert warc.normalise_stream(io.BytesIO(b""), io.BytesIO(), "f") == []


def test_warc_keeps_bytes_that_are_no_text(spark, tmp_path):
    pages = spark.sql("SELECT 1L AS page_id, cast(unhex('61ff62') AS string) AS url, cast(unhex('00ff80') AS string) AS html")
    index = warc.normalise(warc.write_monolithic(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/m")
    got = warc.read_records(index).first()
    assert (bytes(got["block"]), got["target_uri"]) == (b"\x00\xff\x80", "a\ufffdb")


# HTML.


def test_html_keeps_the_article_only(spark):
    body = "<p>" + prose(1, 60) + ".</p><p>" + prose(2, 50) + " &amp; <b>more</b></p>"
    page = f"<html><head><title>t</title><script>if (a<b) 'x'</script></head><body><nav><ul>{''.join(f'<li><a href=/{i}>item</a></li>' for i in range(9))}</ul></nav><!-- c --><article><h1>Head</h1>{body}</article><footer>&copy; us</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "plain <b>words</b>"), (5, "x " * 100), (6, page), (7, "<p>" + "word " * 200_000 + "</p>"), (8, "<script>" + "a " * 300)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("__x", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(df).collect()}
    assert got[1] == got[6] == f"Head\n{prose(1, 60)}.\n{prose(2, 50)} & more"
    assert got[2] is None and got[3] == got[4] == got[8] == "" and got[5] == ("x " * 100).strip() and len(got[7]) == 999_999
    assert html_extract.extract_text(df.limit(0)).columns == ["page_id", "html", "__x", "text"]


# Language model.


def walk(seed, n=120):
    follows = {w: random.Random(w).choices(WORDS, k=3) for w in WORDS}
    rnd, w, out = random.Random(seed), WORDS[seed % 400], []
    for _ in range(n):
        out.append(w)
        w = rnd.choice(follows[w])
    return " ".join(out)


def test_lm_learns_and_scores(spark):
    train = docs_of(spark, [walk(i) for i in range(800)]).repartition(2)
    model = lm.train_lm(train)
    held = docs_of(spark, [walk(i) for i in range(1000, 1040)] + [prose(i, 120) for i in range(40)] + ["", None, "solo"])
    got = {r["doc_id"]: r for r in lm.score_lm(held, model).collect()}
    walked, random_text = (np.mean([-got[i]["log_prob"] / got[i]["n_tokens"] for i in r]) for r in (range(40), range(40, 80)))
    assert walked < random_text - 0.8 and walked < np.log(400) - 0.8
    assert (got[80]["n_tokens"], got[80]["log_prob"], got[80]["perplexity"]) == (0, 0.0, None) == (got[81]["n_tokens"], got[81]["log_prob"], got[81]["perplexity"])
    assert got[82]["n_tokens"] == 1 and got[82]["perplexity"] > 1


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    for name, value in (("FEW_WORDS", 100), ("FAN", 2)):
        monkeypatch.setattr(lm, name, value)
    docs, held = docs_of(spark, [walk(i) for i in range(300)]), docs_of(spark, [walk(i) for i in range(1000, 1020)])
    got = [np.array([r["perplexity"] for r in lm.score_lm(held, lm.train_lm(docs.repartition(n), max_bits=11)).orderBy("doc_id").collect()]) for n in (1, 4, 32)]
    assert np.allclose(got[0], got[1], rtol=1e-9) and np.allclose(got[0], got[2], rtol=1e-9)


def rows_by_hand(model, words, i):
    """Weight rows of word i of a text, by level and feature, and what is chosen there, in whole numbers."""
    m64, w = (1 << 64) - 1, model.width

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    a, b, c = (words[i - k][0] if i >= k else 1 << 32 for k in (1, 2, 3))
    pair = int(lm._PAIR)
    hashed = [mixed((f + 1) * int(s) & m64) for f, s in zip((a, a * pair + b, b, a * pair + c), lm._SALT)]
    y = words[i][1]
    for level, (choice, prefix) in enumerate(((y // w // w, None), (y // w % w, y // w // w), (y % w, y // w))):
        salt = level * int(lm._SALT[1]) if prefix is None else (prefix + (level << 32)) * int(lm._PREFIX) & m64
        yield level, choice, prefix or 0, [(h ^ salt) * int(lm._ROW) % (1 << 64) >> 64 - model.bits for h in hashed]


def chances(model, level, prefix, rows):
    x = model.bias[level][prefix].astype(float) + sum(model.weights[level][r].astype(float) for r in rows)
    return np.exp(x) / np.exp(x).sum()


def test_lm_training_against_brute_force(spark, monkeypatch):
    """Round by round, word by word: softmaxes, observed and expected counts, steps. With many draws the expected counts
    are the sums of the probabilities."""
    monkeypatch.setattr(lm, "DRAWS", 200)
    texts = [walk(i, 5 + i % 30) for i in range(60)] + ["", None, "a", walk(3, 8)]
    docs, rounds = docs_of(spark, texts), (1, 2, 3)
    got = lm.train_lm(docs, max_width=9, max_bits=10, rounds=rounds)
    word, starts = lm.short_hashes([t or "" for t in texts])
    seen = Counter(word.tolist())
    top = sorted((w for w in seen if seen[w] > 1), key=lambda w: (-seen[w], w))
    model = lm.new_model(np.array(top, np.uint32), np.array([seen[w] for w in top]), len(word), got.width, got.bits)
    assert np.array_equal(model.known, got.known) and np.array_equal(model.outcome, got.outcome) and all(np.allclose(a, b) for a, b in zip(model.bias, got.bias))
    of_doc = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(6))).collect()}
    outcomes = model.outcomes(word).tolist()
    for edges in ((0,), (1, 2), (3, 4, 5)):
        counts = np.zeros((2, 3, 1 << model.bits, model.width))
        for d in range(len(texts)):
            if of_doc[d] in edges and texts[d]:
                words = list(zip(word[starts[d] : starts[d + 1]].tolist(), outcomes[starts[d] : starts[d + 1]]))
                for i in range(len(words)):
                    for level, y, prefix, rows in rows_by_hand(model, words, i):
                        p = chances(model, level, prefix, rows)
                        for r in rows:
                            counts[0, level, r, y] += 1
                            counts[1, level, r] += p
        for level in range(3):
            model.weights[level] += (lm.STEP * np.log((counts[0, level] + lm.SMOOTH) / (counts[1, level] + lm.SMOOTH))).astype(np.float32)
    assert all(np.abs(a - b).max() < 0.01 and np.abs(a).max() > 0.05 for a, b in zip(model.weights, got.weights))


def test_lm_packs_counts():
    for x in (np.zeros(6, np.int32), np.array([1, 70_000, 0, 3], np.int32), np.array([1, 5 << 33], np.int64)):
        assert np.array_equal(lm.unpacked(lm.packed(x), len(x)), x)


def test_lm_draws_are_the_distribution():
    word, starts = lm.short_hashes([prose(i, 400) for i in range(40)])
    model = lm.new_model(np.unique(word), np.arange(len(np.unique(word)))[::-1] + 1, 90_000, width=8, bits=10)
    sums = lm.Counts(model)
    sums.add(word, model.outcomes(word), starts)
    drawn = sums.expected[0].reshape(-1, 8).sum(0) / sums.expected[0].sum()
    assert np.allclose(drawn, np.exp(model.bias[0][0]), atol=0.005) and sums.expected[0].sum() == lm.DRAWS * sums.observed[0].sum() == lm.DRAWS * 4 * len(word)


def test_lm_scores_by_hand():
    """The batch scores are those of softmaxes worked out word by word."""
    rnd = np.random.default_rng(1)
    word, starts = lm.short_hashes([prose(1, 9), "", prose(2, 4)])
    model = lm.new_model(np.unique(word)[:6], width=8, bits=10)
    for w in model.weights:
        w[:] = rnd.normal(size=w.shape)
    outcomes = model.outcomes(word)
    got, want = lm.log_probs(model, word, outcomes, starts), []
    for a, b in zip(starts, starts[1:]):
        words = list(zip(word[a:b].tolist(), outcomes[a:b].tolist()))
        want += [sum(np.log(chances(model, level, prefix, rows)[y]) for level, y, prefix, rows in rows_by_hand(model, words, i)) for i in range(len(words))]
    assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(lm.log_probs(model, word[9:], outcomes[9:], np.array([0, 4])), got[9:], atol=1e-5)


def test_lm_works_in_blocks(monkeypatch):
    word, starts = lm.short_hashes([prose(1, 50), "a", prose(2, 70), "b c"])
    model = lm.new_model(np.unique(word), width=8, bits=10)
    for i, w in enumerate(model.weights):
        w[:] = np.random.default_rng(i).normal(size=w.shape)
    args = word, model.outcomes(word), starts
    want = lm.log_probs(model, *args)
    monkeypatch.setattr(lm, "BLOCK", 2)
    assert np.allclose(lm.log_probs(model, *args), want, atol=1e-6)


@pytest.mark.parametrize("common", [1 << 20, 40, 0])
def test_lm_every_word_has_its_own_part_of_its_outcome(spark, monkeypatch, common):
    """Against counts by hand, with words whose counts are broadcast, looked up in parts, or missing."""
    for name, value in (("COMMON", common), ("FEW_WORDS", 500), ("HELD_WORDS", 100), ("ROW_WORDS", 16)):
        monkeypatch.setattr(lm, name, value, raising=False)
    texts = [prose(i, 60) for i in range(60)] + ["rare " * 9 + "once", None, "", prose(0, 60)]
    model = lm.train_lm(docs_of(spark, texts).repartition(3), max_width=2, max_bits=10)
    held = texts + ["rare", "once", "never heard of", "rare"]
    got = {r["doc_id"]: r for r in lm.score_lm(docs_of(spark, held).repartition(4), model).collect()}
    n, own = Counter(w for t in texts if t for w in t.split()), lm.own_outcomes(2)
    of = {w: int(model.outcomes(lm.short_hashes([w])[0])[0]) for w in {*n, "never", "heard", "of"}}
    sizes = Counter()
    for w in n:
        sizes[of[w]] += n[w]
    assert len(got) == len(held) and len([w for w in n if of[w] >= own]) > 300
    for i, t in enumerate(held):
        word, starts = lm.short_hashes([t or ""])
        want = lm.log_probs(model, word, model.outcomes(word), starts).sum() + sum(np.log((n[w] or 1) / (sizes[of[w]] + 1)) for w in (t or "").split() if of[w] >= own)
        assert got[i]["n_tokens"] == len(word) and got[i]["log_prob"] == pytest.approx(want, abs=1e-4), t
        assert got[i]["perplexity"] == (pytest.approx(np.exp(-want / len(word)), rel=1e-4) if len(word) else None)


def test_lm_counts_and_no_words(spark):
    texts = [prose(i, 50) for i in range(30)] + [None, ""]
    want = Counter(w for t in texts if t for w in t.split())
    got = sorted(r["n"] for r in lm.count_words(lm._stored(docs_of(spark, texts).repartition(3), "text", lm.ROUNDS)).collect())
    assert got == sorted(want.values())
    empty = docs_of(spark, [None, ""])
    model = lm.train_lm(empty)
    assert lm.score_lm(docs_of(spark, ["a b"]), model).first()["perplexity"] == pytest.approx(model.width**3, rel=1e-3)
    clash = docs_of(spark, ["a"]).withColumn("log_prob", F.lit(1))
    assert lm.score_lm(clash, model).columns[-3:] == ["n_tokens", "_log_prob", "perplexity"]


# Quality.


def junk(seed):
    return " ".join(w.upper() + "!!" for w in prose(seed, 60).split()) if seed % 2 else (prose(seed, 3) + " ") * 30


def test_quality_held_out(spark):
    texts = [prose(i, 80) if i % 3 else junk(i) for i in range(900)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(450)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = set(ids(quality.quality_filter(docs, labels)))
    right = [(i in got) == (i % 3 > 0) for i in range(450, 900)]
    assert np.mean(right) > 0.97
    assert quality.quality_filter(docs, labels).columns == docs.columns
    few = quality.fit_quality(docs, labels, train_rows=50)
    assert len(few.tables) == len(quality.FEATURES)


def test_quality_edges(spark):
    docs = docs_of(spark, [None, "", "x" * 200_000, "a", "a"]).withColumn("quality_score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, none))
    assert [r["_quality_score"] for r in scored.collect()] == [0.5] * 5
    assert quality.quality_filter(docs, none).count() == 5 and quality.quality_filter(docs.limit(0), none).count() == 0
    model = quality.fit_quality(docs, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id bigint, quality int"))
    assert model.score(np.zeros((1, len(quality.FEATURES))))[0] > 0.5


def test_quality_calls_python_once_and_bounds_its_cases(spark, tmp_path):
    docs_of(spark, ["a", "b"]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    assert plan(quality.quality_filter(docs, labels)).count("ArrowEvalPython") == 1
    many, seen = docs_of(spark, [f"text {i}" for i in range(50)]).withColumn("doc_id", F.lit(0).cast("bigint")), []
    real = quality.train
    try:
        quality.train = lambda x, y: seen.append(len(x)) or real(x, y)
        quality.fit_quality(many, labels, train_rows=7)
    finally:
        quality.train = real
    assert seen == [7]


def leaf(cases):
    return sum(g for g, _ in cases) / (sum(h for _, h in cases) + 1.0)


def worth(cases):
    return sum(g for g, _ in cases) * leaf(cases)


def test_boosting_against_brute_force(monkeypatch):
    """The additive model and its pairs, case by case, with every place of the cuts tried."""
    for name, value in (("BINS", 6), ("COARSE", 3), ("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(quality, name, value)
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(60, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    got = quality.train(x, y)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 7)[1:-1]))) for j in range(3)]
    bins = [[sum(v >= c for c in cuts[j]) for j, v in enumerate(row)] for row in x]
    base = np.log((sum(y) + 0.5) / (61 - sum(y) - 0.5))
    f, tables = [base] * 60, np.zeros((3, 6))

    def slopes():
        p = [1 / (1 + np.exp(-v)) for v in f]
        return [(t - q, q * (1 - q)) for t, q in zip(y, p)]

    for _ in range(4):
        for j in range(3):
            s, best = slopes(), None
            for a in range(7):
                for b in range(a, 7):
                    parts = [[c for c, k in zip(s, bins) if lo <= k[j] < hi] for lo, hi in ((0, a), (a, b), (b, 6))]
                    gain = sum(worth(p) for p in parts if p)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, a, b, parts
            _, a, b, parts = best
            for k in range(6):
                tables[j, k] += 0.1 * (leaf(p) if (p := parts[0 if k < a else 1 if k < b else 2]) else 0)
            f = [base + sum(tables[i, k[i]] for i in range(3)) for k in bins]
    assert np.allclose(tables, got.tables, atol=1e-9)
    low = [[min(k * 3 // 6, 2) for k in row] for row in bins]

    def square(p):
        s, best = slopes(), None
        for a in range(4):
            for b in range(4):
                parts = {(u, v): [c for c, k in zip(s, low) if (k[p[0]] >= a) == u and (k[p[1]] >= b) == v] for u in (False, True) for v in (False, True)}
                gain = sum(worth(q) for q in parts.values() if q)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, a, b, parts
        return best

    pairs = sorted([(0, 1), (0, 2), (1, 2)], key=lambda p: -square(p)[0])[:2]
    assert pairs == got.pairs and pairs[0] == (0, 1)
    squares = np.zeros((2, 3, 3))
    for _ in range(3):
        for n, p in enumerate(pairs):
            _, a, b, parts = square(p)
            for u in range(3):
                for v in range(3):
                    squares[n, u, v] += 0.1 * (leaf(q) if (q := parts[u >= a, v >= b]) else 0)
            f = [base + sum(tables[i, k[i]] for i in range(3)) + sum(squares[m, c[q[0]], c[q[1]]] for m, q in enumerate(pairs)) for k, c in zip(bins, low)]
    assert np.allclose(squares, got.pair_tables, atol=1e-9) and np.allclose(f, got.logit(x), atol=1e-9)


def test_pair_tables_learn_what_single_tables_cannot():
    rnd = np.random.default_rng(4)
    x = rnd.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = (x[:, 2] * x[:, 5] > 0).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert (2, 5) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_bin_addition_is_the_sum_of_the_tables():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(200, len(quality.FEATURES)))
    model = quality.train(x, (x[:, 0] > 0).astype(float))
    b = model.bins(x)
    for i in range(0, 200, 37):
        want = model.base + sum(t[b[i, j]] for j, t in enumerate(model.tables)) + sum(t[quality._coarse(b[i, p]), quality._coarse(b[i, q])] for (p, q), t in zip(model.pairs, model.pair_tables))
        assert abs(model.logit(x[i : i + 1])[0] - want) < 1e-9


# Byte-pair encoding.


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks()


def naive(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks.get(a + b, bpe.NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs, default=(bpe.NONE, 0))
        if rank == bpe.NONE:
            return [ranks[p] for p in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_brute_force(ranks):
    rnd = random.Random(6)
    words = [bytes(rnd.choices(b"aabnehtT \xc3\xa9.", k=rnd.randint(1, 60))) for _ in range(300)] + [b"a" * 700, b"ab" * 400, bytes(range(256))]
    for w in words:
        assert bpe.merge_short(w, ranks) == bpe.merge_long(w, ranks) == naive(w, ranks)


def test_bpe_against_a_public_library(spark, ranks):
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [prose(i, 50) for i in range(20)] + ["", "  \n\t x", "日本語 naïve 12345 <|endoftext|>", "don't stop!!", "z" * 5000, "é" * 3000 + " end ", "\U0001f600" * 50, "a b " * 30_000]
    got = bpe.bpe_encode(docs_of(spark, [*texts, None])).orderBy("doc_id").collect()
    assert [r["tokens"] for r in got[:-1]] == [want.encode_ordinary(t) for t in texts]
    assert all(r["round_trip"] for r in got[:-1]) and got[-1]["tokens"] is got[-1]["n_tokens"] is got[-1]["round_trip"] is None


def test_bpe_decode_and_names(spark):
    texts = ["one", "", None, "naïve ☃"]
    df = docs_of(spark, texts).withColumn("tokens", F.lit(0)).withColumn("N_TOKENS", F.lit(0))
    coded = bpe.bpe_encode(df)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "tokens", "N_TOKENS", "_tokens", "_n_tokens", "round_trip"]
    assert [r["text"] for r in bpe.bpe_decode(coded, "_tokens").orderBy("doc_id").collect()] == texts
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    kept = bpe.bpe_encode(docs_of(spark, ["a"]), drop_text=False)
    assert kept.first()["text"] == "a"


def test_ranks_are_read_from_any_path(tmp_path, spark):
    p = tmp_path / "v"
    p.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*(bytes([b]) for b in range(256)), b"ab", b"abab"])))
    got = bpe.bpe_encode(docs_of(spark, ["ababab"]), ranks_path=str(p), pattern=r"\S+").first()["tokens"]
    assert got == [257, 256]


# Sharding.


def test_rebalance_moves_little_and_balances(spark):
    rnd = random.Random(8)
    load = spark.createDataFrame([(i, int(rnd.paretovariate(1.5) * 100)) for i in range(512)], "slot int, bytes bigint")
    start = sharding.initial_map(spark, 8, 512)
    new = sharding.rebalance(start, load, 8)
    rows = new.join(load, "slot").collect()
    assert len(rows) == 512 and {r["shard"] for r in rows} == set(range(8))
    held, total, big = Counter(), sum(r["bytes"] for r in rows), max(r["bytes"] for r in rows)
    for r in rows:
        held[r["shard"]] += r["bytes"]
    assert max(held.values()) <= total / 8 * 1.02 + big + 1
    before = {r["slot"]: r["shard"] for r in start.collect()}
    assert all(r["moved"] or before[r["slot"]] == r["shard"] for r in rows)
    again = sharding.rebalance(new, load, 8).where("moved").count()
    assert again <= sum(r["moved"] for r in rows)
    more = sharding.rebalance(start, load, 10).join(load, "slot").groupBy("shard").count().count()
    fewer = {r["shard"] for r in sharding.rebalance(start, load, 5).collect()}
    assert more == 10 and fewer == set(range(5))


def test_versions_and_assignment(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.save_map(sharding.initial_map(spark), path, 1)
    docs = docs_of(spark, ["a" * i for i in range(50)] + [None]).withColumn("slot", F.lit("mine"))
    load = sharding.slot_bytes(docs)
    assert load.count() == sharding.SLOTS and load.agg(F.sum("bytes"), F.sum("records")).first() == (sum(range(50)), 51)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), load), path, 2)
    assert sharding.load_map(spark, path, 1).where("moved").count() == 0
    got = sharding.assign(docs, sharding.load_map(spark, path))
    assert got.count() == 51 and got.columns[-2:] == ["_slot", "shard"]
    with pytest.raises(Exception):
        sharding.save_map(sharding.initial_map(spark), path, 1)
    empty = sharding.slot_bytes(docs.limit(0))
    assert sharding.rebalance(sharding.initial_map(spark), empty).where("moved").count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "doc_id bigint, text string")
    assert sharding.assign(nulls, sharding.initial_map(spark)).select("shard").distinct().count() == 1


# Plans.


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_stays_in_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    text = plan(html_extract.extract_text(spark.read.parquet(str(tmp_path / "pages"))).select("page_id", "text"))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text and "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_encoding_reads_two_columns_and_shuffles_nothing(spark, tmp_path):
    docs_of(spark, ["a"]).write.parquet(str(tmp_path / "docs"))
    text = plan(bpe.bpe_encode(spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text")))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_assignment_broadcasts_the_map_only(spark, tmp_path):
    docs_of(spark, ["a"]).write.parquet(str(tmp_path / "docs"))
    text = plan(sharding.assign(spark.read.parquet(str(tmp_path / "docs")), sharding.initial_map(spark)).select("doc_id", "shard"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "ReadSchema: struct<doc_id:bigint>" in text
