"""The operators against plain versions, on small edge cases and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillvec.llm import (
    exact_dedup,
    graph,
    language_id,
    packing,
    private_spans,
    quality_rules,
    queries,
    sampled_pieces,
    sharding,
    shingle_join,
    site_tree,
    sql,
    suffix_dedup,
)

SF = "/root/testdata/sf0.001"
# The SQL of op12 reads this table; DuckDB finds it here by its name.
conversations = pq.read_table(f"{SF}/conversations.parquet")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, spans int, key string"
LONG = "the quick brown fox jumps over the lazy dog near 12 old mills and " * 400
EDGE = [
    None,
    "",
    " \t\n",
    "one two",
    "Ünïcode 😀 words, a@b.co and 10.0.0.1 or +1 (555) 555-1234 with 4111 1111 1111 1111",
    "same text here again for five words",
    "same  text here again\nfor five words",
    "same text here again for five words",
    LONG,
    LONG + "x",
    "q" * 5000,
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", None if i % 3 else "s", 0, "w", 1, 2, "k") for i, t in enumerate(EDGE)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no id at all, still a text of some words", None, "s", 0, "", 0, 0, ""))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "pack": packing.pack,
    "repeats": suffix_dedup.remove_repeats,
    "language": lambda d: language_id.identify(d, language_id.learn(d)),
    "shards": sharding.stratified_shards,
    "spans": private_spans.digest,
    "redact": private_spans.redact,
    "rules": quality_rules.judge,
    "keep": quality_rules.keep,
    "copies": exact_dedup.exact_groups,
    "similar": shingle_join.similar_classes,
    "pieces": lambda d: sampled_pieces.encode(d, ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(edges, empty, name):
    assert OPERATORS[name](empty).count() == 0
    rows = OPERATORS[name](edges).collect()
    if name not in ("pack", "keep", "pieces"):
        assert len(rows) == len(EDGE) + 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_measures(edges):
    for r in quality_rules.measures(edges.drop("n_words")).collect():
        w = words(r.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))


def test_exact_groups(edges):
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(edges).collect()}
    assert rows[0].keep_id == rows[1].keep_id == 2 and rows[2].kept and rows[0].group_size == 3
    assert rows[5].keep_id == rows[7].keep_id == 6 and rows[5].group_size == 4
    assert rows[6].text_sha256 == hashlib.sha256(b"sametexthereagainforfivewords").hexdigest()


def test_directory_splits_full_buckets(spark):
    sizes = spark.createDataFrame([(i << 55, 10) for i in range(-256, 256)], "key long, bytes long")
    depth, slots = exact_dedup.directory(sizes, 100, 2)
    assert [s for s, _ in slots] == list(range(1 << depth)) and depth >= 6


def test_a_long_text_does_not_deepen_the_directory(spark):
    small = [((i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63), 70) for i in range(500)]
    sizes = spark.createDataFrame([*small, (12345, 1 << 20)], "key long, bytes long")
    depth, slots = exact_dedup.directory(sizes, 1 << 18, 6)
    assert depth == 0 and slots == [(0, 0)]
    # Several long keys with one prefix: the depth stays bounded.
    close = spark.createDataFrame([(5 + i, 1 << 20) for i in range(3)], "key long, bytes long")
    depth, slots = exact_dedup.directory(close, 1 << 18, 6)
    assert [s for s, _ in slots] == list(range(1 << depth)) and depth <= 12


def test_exact_groups_of_a_very_long_text(spark):
    texts = ["word " * 200_000, *(f"text {i % 20}" for i in range(40)), " word" * 200_000]
    rows = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 42 and {r.doc_id for r in rows if r.kept} == set(range(21))
    assert {r.group_size for r in rows} == {2}


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 512) for _ in range(600)]
    windows = packing.pack_block(sizes)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(600))
    assert max(sums) <= 2048 and max(sums) - min(sums) < 60


def test_packing_cuts_every_id_once(edges):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(edges.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    sequences = {}
    for i, text in enumerate(EDGE):
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize(
    "text",
    [
        "before <|endoftext|> after<|endoftext|>",
        " " * 1_000_000 + "x",
        "\n" * 1_000_000,
        "a" * 200_000,
        "\u0085\u00a0\u2003 z\U0001f600\u0301",
    ],
)
def test_encoder_gives_the_ids_of_the_tokenizer_file(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def brute_repeats(texts):
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        out.append(hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    texts = []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))
        cut = rng.randint(0, 250)
        texts.append(own + passage[cut : cut + rng.randint(90, 260)] + own[:120] * (i % 3))
    texts += [texts[3], "ab" * 300, passage * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert [rows[i].kept_sha256 for i in range(len(texts))] == brute_repeats(texts)


def test_longest_previous_factor():
    text = "abaababaabaab"
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def common(a, b):
        return next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]))

    lcp = [0] + [common(order[i - 1], order[i]) for i in range(1, len(order))]
    got = suffix_dedup.longest_previous(np.array(order), np.array(lcp))
    assert all(got[i] == max([common(p, q) for q in range(p)], default=0) for i, p in enumerate(order))


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


@pytest.mark.parametrize("fragment", [4096, 7])
def test_similar_classes_against_brute_force(spark, monkeypatch, fragment):
    monkeypatch.setattr(shingle_join, "FRAGMENT", fragment)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "a b", "A B", "x"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_classes(df).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_classes(texts)


def test_words_of_a_regular_pattern_are_told_apart(spark):
    # Equal under every sum of bytes times powers modulo 2**64 (Thue-Morse words).
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"one two {word} three four", f"one two {other} three four", other.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_classes(df).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_classes(texts)


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)]
    rows = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.label for r in rows} == {0, 1000} and len(rows) == 61 + 90


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "_d@e.f", "..", "1.2.3.4", ".5.6.7", "256.1.1.1", "4111 1111-1111 1111", "+1 (23) 456-7890",
             "+49..", "x", "é", "😀", " ", "@", "-", "378282246310005", "007.08.009.1", "bob (at) corp (dot) com"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in private_spans.digest(df).collect():
        found = [
            f"{k}:{m.start()}:{m.end()}"
            for k, p in BASE.items()
            for m in re.finditer(p, r.text)
            if holds(k, m.group())
        ]
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest(), r.text
        assert set(found) <= set(r.spans.split(","))


def test_votes_learn_reliability():
    rows = [((0, 1, 1, 1), 0, 900), ((-1, -1, -1, 0), -1, 900), ((0, 1, 1, 0), 0, 80)]
    counts = [(0, (*votes, 0, 0, border), n) for votes, border, n in rows]
    model = private_spans.fit(counts)
    assert model.reliability["valid"] > 0.9 and model.weights["valid"][1] > 0 > model.weights["listed"][0]


def test_shards_follow_the_mixture(spark):
    df = spark.range(1003).selectExpr("id doc_id", "'t' text", "case when id % 3 = 0 then 'a' else 'b' end source")
    rows = sharding.stratified_shards(df).collect()
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    mix = Counter(r.shard for r in rows if r.source == "a")
    assert max(mix.values()) - min(mix.values()) <= 2
    for s, n in per.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.text_crc32 == zlib.crc32(b"t") and r.size == 2 for r in rows)


def test_language_accuracy(spark):
    rows = queries.op3_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


PAGE = """<html><head><title>t</title><style>x</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=ad1 class='ad "x'>Buy</div>{0}<form><p>Name</form>
<section class="comments"><p>First!</section><footer>&copy; all<p>rights"""


def test_pages():
    body = "<article><h1>A &amp; B</h1><p>one <b>two<br>three</b>\n four<p>five<ul><li>s<li>t</ul><aside>no</aside></article>"
    want = "A & B\n\none two three four\n\nfive\n\ns\n\nt"
    assert site_tree.Page(PAGE.format(body)).text() == want
    assert site_tree.Page(PAGE.format(body.replace("article", "div"))).text() == want
    assert site_tree.Page("plain < text <b").text() == "plain < text"
    assert site_tree.Page("<script>if (a<b) {}").text() == ""


def test_site_tree_drops_what_every_page_repeats(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<body><div><p>Always the same line</div><div class=x><p>Page {i} says {i * 7}</div></body>")
        for i in range(30)
    ] + [(99, None, None), (98, "http://other/", "<p>Always the same line")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.main_texts(df).collect()}
    assert got[3] == "Page 3 says 21" and got[99] == "" and got[98] == "Always the same line"
    assert site_tree.main_texts(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("mark", ["article", "div"])
def test_copies_of_a_page_erase_no_text(spark, mark):
    def page(i):
        body = f"<div class=box><p>Text {i} of {i * 7}</p><ul><li>Item {i}</li></ul></div>"
        return f"<body><div class=top>Our site</div><{mark} class=content>{body}</{mark}></body>"

    rows = [(i, f"http://h.example/{i}", page(max(i, 899))) for i in range(1000)]
    rows += [(1000 + i, f"http://copies.example/{i}", page(0)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.main_texts(df).collect()}
    want = {i: f"Text {k} of {k * 7}\n\nItem {k}" for i in range(1020) for k in [0 if i >= 1000 else max(i, 899)]}
    assert {i: got[i].removeprefix("Our site\n\n") for i in got} == want
    assert all(not got[i].startswith("Our site") for i in range(1000))


def test_an_article_is_not_judged_by_importance():
    page = "<body><article><section class=s><ul><li>one</ul><table><tr><td>two</table></section></article></body>"
    path = ("body", "article", "section.s")
    below = ((), ("ul",), ("table",), ("table", "tr"))
    low = frozenset(site_tree.path_of(*path, *more) for more in below)
    assert site_tree.Page(page, low).text() == "one\n\ntwo"


@pytest.mark.parametrize(
    "body",
    [
        "<div class='layout with-sidebar'><article>{0}</article></div>",
        "<div class='content no-sidebar'>{0}</div>",
        "<div id='site-header-fixed'>{0}</div>",
        "<div class=sidebar><article>{0}</article></div>",
        "<div class=sidebar>gone<article>{0}</article>gone</div>",
        "<article><div class='article-header'><h1>Title</h1></div><p>Text</p></article>",
        "<article><div class='entry-header'><h1>Title</h1></div><div class=share>gone</div><p>Text</p></article>",
        "<article><h1>Title</h1><section class=related-work><p>Text</p></section></article>",
        "<article><h1>Title</h1><div class=tags-and-text><p>Text</p></div></article>",
        "<article><h1>Title</h1><div class=notice-text><p>Text</p></div></article>",
        "<article>{0}</article><div class=comments><article>gone</article></div>"
        "<div class=related><article>gone</article></div>",
        "{0}<aside><article>gone</article></aside><div class='box cookie-notice siteFooter'>gone</div>",
    ],
)
def test_words_of_a_class_do_not_drop_text(body):
    page = body.format("<h1>Title</h1><p>Text</p>")
    assert site_tree.Page(f"<body>{page}</body>").text() == "Title\n\nText"


class _Tiny(sampled_pieces.Lattice):
    def __init__(self):
        self.weight = {p: (i, w) for i, (p, w) in enumerate([("▁", -1.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2), ("▁a", -0.7)])}
        self.bytes, self.byte_weight, self.longest = list(range(100, 356)), -5.0, 2
        self.clear()


def test_samples_follow_the_lattice():
    tiny, first, runs = _Tiny(), Counter(), 3000
    for i in range(runs):
        rows = sampled_pieces.sample("ab", 2, random.Random(i), tiny)
        assert len({r[0] for r in rows}) == 2 and rows[0][2] >= rows[1][2]
        first[rows[0][0]] += 1
    weights = {(0, 1, 2): -3.5, (0, 3): -2.2, (4, 2): -2.2}
    total = sum(np.exp(w) for w in weights.values())
    for ids, w in weights.items():
        assert abs(first[ids] / runs - np.exp(w) / total) < 0.04
    everything = sampled_pieces.sample("ab", 9, random.Random(0), tiny)
    assert len(everything) == 3 and all(r[3] == 1.0 for r in everything)


def test_pieces_round_trip(spark):
    rows = queries.op10_sampled_pieces(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows)
    texts = [t for t in EDGE if t and len(t) < 200]
    pieces = sampled_pieces.lattice(sampled_pieces.model_path())
    for t in texts:
        for ids, *_ in sampled_pieces.sample(t, 3, random.Random(1), pieces):
            assert pieces.decode(list(ids)) == t


@pytest.mark.parametrize("name", sql.ORACLES)
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(sql.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(
        str(tuple(row[i] for i in order)) for row in want.fetchall()
    )


def test_pipeline_keeps_one_of_each_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").select("doc_id").collect()}
    best = {}
    for d in sorted(good):
        t = re.sub(r"[\x20\x09-\x0D]", "", texts[d])
        if t not in best or len(texts[d]) > len(texts[best[t]]):
            best[t] = d
    left = sorted(best.values())
    label = brute_classes([texts[d] for d in left])
    kept = {left[i] for i, (_, c) in enumerate(label) if c == i}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_sets_without_an_id_link_others(spark):
    base = [f"w{i}" for i in range(100)]
    step = [" ".join(["x"] * k + base[k:]) for k in (0, 9, 18)]  # neighbours are similar, the ends are not
    texts = [(1, step[0]), (None, step[1]), (None, step[1]), (3, step[2]), (None, "some other words of its own here")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shingle_join.similar_classes(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 1), (0, 1), (1, 1), (3, 1)]


def test_stages_keep_rows_without_an_id(spark, edges):
    other = "another text of quite different words that nobody else has " * 2
    near = " ".join(f"v{i}" for i in range(100))
    more = [(None, t, "en", "s", 0, "w", 1, 2, "k") for t in (other, near, near + " z", "  " + EDGE[6], near + " z ")]
    docs = edges.union(spark.createDataFrame(more, SCHEMA)).repartition(3)
    distinct = corpus_pipeline.distinct_texts(spark, docs, SF)
    texts = Counter((r.doc_id, r.text) for r in distinct.collect())
    lone = "no id at all, still a text of some words"
    assert Counter((None, t) for t in (other, near, near + " z ", "  " + EDGE[6], lone)) <= texts
    groups = {re.sub(r"\s", "", r.text or "") for r in docs.collect()}
    assert sorted(re.sub(r"\s", "", t or "") for _, t in texts.elements()) == sorted(groups)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.dissimilar_texts(spark, distinct, SF).collect()]
    assert (None, other) in left and (None, lone) in left and (None, "  " + EDGE[6]) in left
    assert len([t for _, t in left if t and t.startswith(near)]) == 1
    assert len(left) == len(texts) - 2  # LONG and LONG + "x", and the two of near
    # The other stages lose no row for want of an id; the rules reject the other texts for their words.
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert [r.text for r in good.where("doc_id is null").collect()] == [lone]
    assert corpus_pipeline.without_private_data(spark, docs.drop("spans"), SF).count() == docs.count()
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.where("start = 0").count() == docs.count()


def test_shingles_sent_to_many_owners_stay_small():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(500)]
    keys = [shingle_join.set_key(s) for s in sets]
    assert min(keys) < 0 < max(keys)
    rows = sum(len(s) for s in sets)
    wide = list(shingle_join._sent(zip(keys, sets, strict=True), 600))
    brief = list(shingle_join._sent(zip(keys, sets, strict=True), 600, brief=True))
    # 8 bytes of a shingle, 8 of a key and 4 of a place each before: 20 in all.
    assert sum(b.nbytes for b in brief) < 15 * rows
    for packs, mask in ((wide, (1 << 64) - 1), (brief, (1 << 48) - 1)):
        token, key, new = shingle_join._met(iter(packs), brief=packs is brief)
        pairs = {(int(t), int(k) & mask) for t, k in zip(token, key, strict=True)}
        part = (1 << 64) - 1 if packs is wide else (1 << 32) - 1
        assert pairs == {(int(t) & part, k & mask) for k, s in zip(keys, sets, strict=True) for t in s}
        assert new.sum() == len({t for t, _ in pairs})


def test_shared_shingles_of_copies_and_others(spark):
    words = [f"w{i}" for i in range(60)]
    one, two, three = " ".join(words), " ".join(words[:40]), " ".join(f"v{i}" for i in range(50))
    texts = [one, two, three, three.upper(), one, None]  # a copy alone shares nothing
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4).coalesce(3)
    found = {r["name"]: r.shared for r in shingle_join.shared_counts(df.fillna("")).collect()}
    sets = [next(shingle_join.shingle_sets([t.encode()])) for t in (one, two, three)]
    want = {}
    for s in sets:
        others = set().union(*(map(int, o) for o in sets if o is not s))
        held = len(others & set(map(int, shingle_join.sampled(s))))
        want |= {shingle_join.set_key(s) & ((1 << 48) - 1): held} if held else {}
    assert found == want and len(want) == 2
