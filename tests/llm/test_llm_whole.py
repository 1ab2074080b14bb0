"""Inputs of which a smaller rule would lose a part."""

import html as pyhtml
from html.entities import html5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from needlebed.llm import html_extract, mixing, queries


def texts_of(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    return [r["text"] for r in html_extract.extract_text(df).orderBy("page_id").collect()]


LINE = "Sixty characters of dialogue or of verse stand in this line."
LONG = "a long paragraph " * 20


def test_html_keeps_runs_of_short_paragraphs(spark):
    items = "".join(f"<li><a href=/{i}>item</a></li>" for i in range(40))
    page = f"<body><nav><ul>{items}</ul></nav><article>%s</article><footer><p>{LINE}</p> <p>{LINE}</p></footer></body>"
    got = texts_of(spark, page % (f"<p>{LINE}</p>" * 1000), page % (f"<div> <p>{LINE}</p>&nbsp;</div>\n" * 9), page % f"<p>{LINE}</p><p>{LINE}</p>")
    assert got == ["\n".join([LINE] * 1000), "\n".join([LINE] * 9), ""]


def test_html_keeps_lists_tables_and_sections_between_text(spark):
    inner = "<ul><li>one</li><li>two</li><li>three</li></ul>A closing sentence.<table><tr><td>a</td><td>b</td></tr></table><dl><dt>k</dt><dd>v</dd></dl><section><h2>Head</h2><p>Short.</p></section>"
    page = f"<body><nav>menu</nav><article><p>{LONG}</p>{inner}<p>{LONG}</p></article><footer>end</footer></body>"
    assert texts_of(spark, page) == ["\n".join([LONG.strip(), "one", "two", "three", "A closing sentence.", "a", "b", "k", "v", "Head", "Short.", LONG.strip()])]


def test_html_keeps_pages_whose_head_or_drawing_is_not_closed(spark):
    head, want = "<html><head><meta charset=utf-8><title>a title</title>\n<style>p{}</style><link rel=x>", LONG.strip()
    pages = [f"{head}<body><p>{LONG}</p>", f"{head}<p>{LONG}</p>", f"{head}{LONG}", f"{head}</head><body>{LONG}</body>", *[f"{head}<body><{t} a=b>{LONG}" for t in ("noscript", "template", "svg")]]
    pages += [f"<head><noscript><link></head><p>{LONG}", f"<p>{LONG}</p><svg><text>{LONG}</text></svg><noscript>{LONG}</noscript>", "<head>" + "<meta a=b> " * 50_000 + f"<p>{LONG}"]
    assert texts_of(spark, *pages) == [want] * len(pages)
    assert texts_of(spark, f"<p>x</p><script>{LONG}", f"<!-- {LONG}") == ["", ""]


def test_html_decodes_every_reference_once(spark):
    """Against the decoder of Python's library."""
    plain = "caf&eacute; na&#239;ve it&#8217;s &#x1F600; &amp;lt; &amp;amp; AT&T x&y &nosuch; &#; &#xZ; &copy 5 &notit; &#128; &#0; &#1114112; &#xD800; &#99999999999999999999; fish & chips &lt;b&gt; &quot;"
    names = " ".join("&" + n for n in sorted(html5) if n.endswith(";") and not html5[n].isspace() and "\u200b" not in html5[n])
    want = lambda t: " ".join(pyhtml.unescape(t).replace("\xa0", " ").split())
    assert texts_of(spark, f"<p>{plain} {LONG}</p>", f"<p>{names}</p>") == [want(f"{plain} {LONG}"), want(names)]


def test_html_replaces_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG}", "old", 7)], "page_id bigint, html string, text string, needlebed_lines int")
    got = html_extract.extract_text(df)
    assert got.columns == df.columns and got.first()[2:] == (LONG.strip(), 7)


def test_mix_against_brute_force(spark):
    """Which rows, with repeated ones and ties that are split: by part, hash, id, then the other columns."""
    rows = [(i % 150, " ".join(["w"] * (1 + i % 7)) + f" {i % 40}", f"s{i % 2}", i // 150) for i in range(600)] + [(7, "same text", "s0", 9)] * 25
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, k int")
    hashed = df.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect()
    for share in (0.1, 0.37, 0.8):
        total = {s: sum(len(r["text"].split()) for r in hashed if r["source"] == s) for s in ("s0", "s1")}
        largest, weights = int(min(total["s0"] / 3, total["s1"]) * 4), {"s0": 3.0, "s1": 1.0}
        budget = max(largest, int(sum(total.values()) * share))
        parts = {"s0": min(total["s0"], budget * 3 // 4), "s1": min(total["s1"], budget // 4)}
        parts = {s: max(parts[s], min(total[s], budget - total[o])) if total[o] <= budget * weights[o] / 4 else parts[s] for s, o in (("s0", "s1"), ("s1", "s0"))}
        want = []
        for s, part in parts.items():
            cells = {}
            for r in hashed:
                if r["source"] == s:
                    cells.setdefault(len(r["text"].split()), []).append(r)
            lengths = sorted(cells)
            take, _ = mixing.fit(lengths, [len(cells[n]) for n in lengths], part)
            for n, t in zip(lengths, take):
                want += sorted(cells[n], key=lambda r: (r["h"] % mixing.PARTS, r["h"], r["doc_id"], r["source"], str(r["k"])))[:t]
        got = mixing.mix_sources(df, weights, share=share).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r)[:4] for r in want)


def test_mix_is_not_as_small_as_its_scarcest_source(spark, tmp_path):
    """One document of a null source and one of a tiny one, beside three that are large."""
    rows = [(i, " ".join(["w"] * (1 + i % 29)), f"src{i % 3}") for i in range(1500)] + [(9000, "a b c", None), (9001, "a b c d", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    has = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("src0", "src1", "src2", None, "tiny")}
    most, n = int(sum(has.values()) * queries.MIX_SHARE), F.size(F.split("text", " "))
    for got in (queries.op1_mixing(spark, str(tmp_path)), corpus_pipeline.mix(spark, df, "")):
        if "text" not in got.columns:
            got = got.join(df.select("doc_id", "text"), "doc_id")
        sums = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum(n)).collect()}
        assert most - 5 <= sum(sums.values()) <= most
        assert (sums[None], sums["tiny"]) == (3, 4) and sums["src1"] == pytest.approx(3 * sums["src2"], abs=3)
    sums = {r[0]: r[1] for r in mixing.mix_sources(df, {"src0": 100.0}, budget=has["src0"] + 4007).groupBy("source").agg(F.sum(n)).collect()}
    assert sums == {"src0": has["src0"], "src1": 2000, "src2": 2000, None: 3, "tiny": 4}
    even = df.where("source LIKE 'src%'")
    assert sorted(r["doc_id"] for r in mixing.mix_sources(even, share=0.01).collect()) == sorted(r["doc_id"] for r in mixing.mix_sources(even).collect())
    assert mixing.mix_sources(df, budget=10**9).count() == len(rows) and mixing.mix_sources(df, budget=0).count() == 0
