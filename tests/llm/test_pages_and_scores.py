"""Page extraction, the language model and the pipeline."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import exact, extraction, language_model, pii, simhash, toxicity
from tests.llm.test_near_copies import plain_set
from tests.llm.conftest import SCHEMA, row

SF = "/root/testdata/sf0.001"


def page(k, skin="article", rng=None):
    rng = rng or random.Random(k)
    say = lambda: " ".join("thing word other some more".split()[rng.randrange(5)] for _ in range(rng.randint(8, 30))) + "."
    main = [f"Heading {k} &amp; more", say(), say() + " <i>inline</i>  text\n here.", say()]
    html = (
        f"<html><head><title>T {k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        f"<div class=ad>{say()}</div><{skin}><h1>{main[0]}</h1><p>{main[1]}<p>{main[2]}</p><!-- </p> --><script>var a='<p>';</script><p>{main[3]}</p></{skin.split()[0]}>"
        f"<div class=comments><p>{say()}</p></div><footer>&copy; 2020 Site &middot; {say()}</footer></body></html>"
    )
    text = "\n\n".join(" ".join(m.replace("&amp;", "&").replace("<i>", "").replace("</i>", "").split()) for m in main)
    return html, text


def test_extract(spark):
    rows = [(k, "u", page(k)[0], "t") for k in range(150)] + [(500, None, None, "t"), (501, "u", "", "t"), (None, "u", page(7)[0], "t"), (502, "u", "<p", "t")]
    rows += [(600 + k, "u", page(k, "div class=content")[0], "t") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    chain = extraction.fit(pages)
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, chain).collect()}
    assert all(got[k] == page(k)[1] for k in range(150)) and got[None] == page(7)[1]
    assert got[500] == got[501] == "" and sum(got[600 + k] == page(k, "div")[1] for k in range(30)) >= 28
    assert extraction.extract(pages.where("false"), extraction.fit(pages.where("false"))).collect() == []


def test_broken_markup():
    text = lambda h: [b.text for b in extraction.blocks_of(h)]
    assert text("a < b &lt; c<br>d<p>e<p>f<div>g</div>h</p>i") == ["a < b < c d", "e", "f", "g", "h", "i"]
    assert text("<p>x<!-- never closed <p>y") == ["x"]
    assert text("<a href='unclosed>x</a><p>z</p>") and text("<script>if (a<b) '</p>'</script>t<noscript><p>n</p></noscript>") == ["t"]
    assert text("<ul><li>a<li>b</ul><textarea><p>q</textarea>c<table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert text("</div></p>" * 100 + "x" + "<div>" * 5_000 + "y") == ["x", "y"]


@pytest.mark.parametrize("page", [
    '<a "' * 250_000, '<a ">"' * 160_000, "<b>" * 160_000 + "</p>" * 130_000, "<b>" * 160_000 + "<div></div>" * 45_000, "<a" * 500_000, "<!" * 500_000,
    "<div>x" * 160_000, "".join(f"<div class=c{k}>x" for k in range(60_000)),
], ids=["quotes", "brackets in quotes", "closes", "blocks under inline elements", "names", "declarations", "nested", "nested classes"])
def test_time_and_memory_follow_the_page(page):
    chain = extraction.Chain()
    chain.weights = {"bias": 1.0, "in:div": 0.5, "name:c": 0.1}
    spent = time.process_time()
    extraction.main_text(chain, page)
    assert time.process_time() - spent < 15  # 2 to 5 seconds; what was quadratic took hours
    tracemalloc.start()
    extraction.blocks_of(page[:200_000])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_scores_of_blocks_are_sums_of_their_features():
    rng = random.Random(8)
    for k in range(20):
        blocks = extraction.blocks_of(page(k)[0])
        rows = extraction.features(blocks)
        chain = extraction.Chain()
        chain.weights = {f: rng.uniform(-1, 1) for f in sorted({f for row in rows for f in row})}
        assert chain.block_scores(blocks) == pytest.approx([sum(chain.weights[f] for f in row) for row in rows])
        assert all(len(set(row)) == len(row) for row in rows)


def test_viterbi_is_the_best_labelling():
    rng, chain = random.Random(5), extraction.Chain()
    chain.weights = {f: rng.uniform(-2, 2) for f in "abcdef"}
    chain.pairs = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    for _ in range(30):
        rows = [rng.sample("abcdef", 2) for _ in range(rng.randint(1, 8))]
        score = lambda y: sum(chain.weights[f] for r, b in zip(rows, y, strict=True) if b for f in r) + sum(chain.pairs[a][b] for a, b in zip(y, y[1:], strict=False))
        every = [[m >> i & 1 for i in range(len(rows))] for m in range(1 << len(rows))]
        assert score(chain.decode(rows)) == pytest.approx(max(map(score, every)))
        single, _ = chain._marginals(chain._unary(rows))
        weights = [math.exp(score(y)) for y in every]
        assert single[:, 1] == pytest.approx([sum(w for w, y in zip(weights, every, strict=True) if y[i]) / sum(weights) for i in range(len(rows))])


def test_word_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    slots = int(language_model.STARTS[-1])
    model = language_model.Model(rng.integers(0, 60, slots, dtype=np.uint8), rng.integers(0, 60, slots, dtype=np.uint8), np.zeros((4, 512)), np.full(4, 0.25))
    model.weights = rng.uniform(-0.2, 0.4, model.weights.shape).astype(np.float32)
    # all continuations of "ab" by one byte, each taken as a whole word without its close
    coded = [bytes([97, 98, b]) for b in range(256)]
    closed = model.log10(coded)
    assert closed.shape == (256, 4) and (closed < 0).all()
    monkey = language_model.Coded
    assert len(monkey([b"", b"ab"]).bytes) == 4
    # without the closing blank: the probabilities of the next byte sum to one under each class
    original = language_model.Coded.__init__

    def unclosed(self, words):
        original(self, words)
        last = np.r_[self.first[1:], len(self.bytes)] - 1
        self.bytes = np.delete(self.bytes, last)
        self.owner = np.delete(self.owner, last)
        self.previous = np.delete(self.previous, last)
        self.contexts = [np.delete(c, last) for c in self.contexts]
        self.first = self.first - np.arange(len(self.first))

    language_model.Coded.__init__ = unclosed
    try:
        total = (10 ** model.log10(coded)).sum(axis=0)
        stem = 10 ** model.log10([b"ab"])[0]
    finally:
        language_model.Coded.__init__ = original
    assert total == pytest.approx(stem, rel=1e-6)


def test_language_model(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 40)  # most words by the join
    got = language_model.score(docs).collect()
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), b""]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 5)) for i, ts in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    words = [r for r in got if r["n_tokens"] > 300 and r["doc_id"] != 101]
    # a known text costs less than one byte's bits a byte
    assert all(-r["score"] / math.log10(2) < 8 * len(dict(tokens)[r["doc_id"]]) * 3 for r in words)
    assert language_model.score(empty).collect() == []


def test_pipeline_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).ready()
    left = [r for r in docs.collect() if model.score(r["text"]) < toxicity.CUT]
    last: dict = {}
    for r in left:
        text = r["text"].encode().lower()
        last[text] = max(last.get(text, -1), r["doc_id"])
    left = {r["doc_id"]: r["text"] for r in left if last[r["text"].encode().lower()] == r["doc_id"]}
    sets = {i: plain_set(t) for i, t in left.items()}
    seen: dict = {}
    for i in sorted(sets):  # components by breadth
        front = [] if i in seen else [i]
        while front:
            a = front.pop()
            seen.setdefault(a, i)
            near = [b for b in sets if b not in seen and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            front += near
            seen.update(dict.fromkeys(near, i))
    left = {i: t for i, t in left.items() if seen[i] == i}
    assert {r["doc_id"] for r in got} == set(left) and len(left) < docs.count()
    clean = {r["doc_id"]: r["text"] for r in pii.replace(docs.where(docs.doc_id.isin(list(left))), corpus_pipeline.SURROGATE_KEY).collect()}
    sizes: dict = defaultdict(int)
    for r in got:
        sizes[r["doc_id"]] += r["length"]
    import public_tokenizers
    import tiktoken

    from tagloom.llm import bpe

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sizes == {i: len(library.encode_ordinary(t)) + 1 for i, t in clean.items()}


def test_stages_take_odd_tables(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, empty):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == table.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert bool(packed) == (table is docs)


def test_queries_agree_with_themselves(spark):
    from tagloom.llm.queries import QUERIES

    count = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_byte_bpe", "op2_quality_rules", "op4_toxicity", "op7_license_scan", "op8_context_mixing", "op9_pii_surrogates"):
        assert QUERIES[name](spark, SF).count() == count, name
    assert exact.exact_groups(spark.createDataFrame([row(1, "x")], SCHEMA)).count() == 1
