"""Each operator against a plain version of what it should compute."""
import hashlib
import html as entities
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edge import BASE, benchmark
from roamlog.llm import bpe, decontaminate, hmm, html, licenses, minhash, quality, queries, secrets, suffixes, tokenids

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def groups(sets, percent):
    """Smallest id reachable through links, from all pairs."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def mutated(rng, words, share):
    return " ".join(f"m{rng.random()}" if rng.random() < share else w for w in words)


def test_near_duplicates(spark, docs, texts):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    more = {1_000_000: " ".join(words)}
    for k in range(1, 120):  # a group whose members are mostly linked through the first one alone
        more[1_000_000 + k] = mutated(rng, words, rng.choice([0.01, 0.02, 0.03]))
    extra = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    every = {**texts, **more}
    got = {r.doc_id: r for r in minhash.near_duplicates(docs.select("doc_id", "text").unionByName(extra), 4).collect()}
    sets = {d: shingles(t, 4) for d, t in every.items()}
    assert {d: r.component_id for d, r in got.items()} == groups(sets, 80)
    assert all(r.n_shingles == len(sets[d]) and r.kept == (d == r.component_id) for d, r in got.items())


def test_decontamination_by_shuffle(spark, docs, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(benchmark(spark, [(901, "a b"), (902, "the"), (903, "The")]))
    first = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert first == sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    the = sum("903" in r[4] for r in first)
    assert the == sum("902" in r[4] for r in first) > 0


def test_quality_counts_and_verdicts(spark, docs, sf_dir, texts):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))

    odd = {10_000: "a b c\x0bd\n\n a \n a \na\n\x1c\x85", 10_001: "x x x x", 10_002: "<p>|&"}
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.assess(all_docs, labels).collect()}
    for d, t in {**texts, **odd}.items():
        r = got[d]
        assert tuple(r[c] for c in quality.COUNTS) == plain(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(all_docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)


def test_quality_held_out(spark):
    """Fitted on the labels of one table, the model tells good from bad in another."""
    root = "/root/testdata/sf0.1"
    read = {n: spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels")}
    half = F.col("doc_id") % 2
    known = read["labels"].filter(half == 0)
    got = quality.assess(read["documents"], known).join(read["labels"].filter(half == 1), "doc_id").filter("NOT base_failed")
    share = {(r["quality"]): r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1, share


def test_secrets(spark):
    key, card = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "4952935900253052"
    rows = [(k, f"Some words here {BASE[k:k + 60]} token = \"{key[k:] + key[:k]}\" and card {card} mail a.12@mail3.example.com", "src") for k in range(30)]
    rows += [(50, f'sha1 checksum {key} of the file', "src"), (51, f'{"é" * 9} token = "{key}" x token = "{key}"', "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(docs).collect()
    by = {r[0]: r[1] for r in rows}
    assert all(by[r.doc_id][r.start : r.start + r.n_chars] == r.value for r in found)
    assert {r.value for r in found if r.doc_id < 40 and not r.is_secret} == {card}
    assert sum(r.is_secret for r in found) == 32
    clean = {r.doc_id: r.text for r in secrets.redact(docs.withColumn("n_chars", F.length("text"))).collect()}
    assert clean[51] == f'{"é" * 9} token = "{secrets.REDACTED}" x token = "{secrets.REDACTED}"'
    labelled = spark.createDataFrame([(k, by[k].index(card), True) for k in range(30)] + [(k, by[k].index('"') + 1, False) for k in range(30)],
                                     "id long, start long, is_secret boolean")
    other = secrets.scan(docs, labelled).collect()
    assert {r.value for r in other if r.doc_id < 40 and r.is_secret} == {card}


def test_the_forest_decides_every_candidate(spark):
    """Truth that no rule knows: findings of half the documents name keys of one make, whatever stands before them. The
    other half is judged by them, also against the rules' own labels."""
    rng = random.Random(2)
    rows, truth = [], {}
    for k in range(300):
        real = k % 3 == 0
        value = "".join(rng.choices("abcdef0123456789" if real else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.choice([32, 36, 40]))) + "7"
        lead = rng.choice(['token = "', 'commit "', "sha1 \"", 'the key "'])
        text = f'{BASE[: rng.randrange(60)]} {lead}{value}" {BASE[:30]}'
        rows.append((k, text, "src"))
        truth[k] = (text.index(value), real)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labelled = spark.createDataFrame([(k, *truth[k]) for k in range(0, 300, 2)], "id long, start long, is_secret boolean")
    got = {r.doc_id: r for r in secrets.scan(docs, labelled).collect()}
    assert len(got) == 300 and all(r.is_secret == (r.score >= 0.5) for r in got.values())
    hit = [(got[k].is_secret, truth[k][1]) for k in range(1, 300, 2)]
    caught, named = sum(a and b for a, b in hit), sum(a for a, _ in hit)
    assert caught / named > 0.9 and caught / sum(b for _, b in hit) > 0.9
    # Without findings the votes alone decide too, whatever label the rules would give.
    own = secrets.scan(docs).collect()
    assert all(r.is_secret == (r.score >= 0.5) for r in own)


def plain_candidates(text):
    """Positions of candidates by one scan with the regex module."""
    import regex

    return [(m.start(), m.group()) for m in regex.finditer(secrets.CANDIDATE, text)]


def test_candidates_equal_a_plain_scan(spark, docs, texts):
    want = {(i, *hit) for i, t in texts.items() for hit in plain_candidates(t)}
    rows = secrets.candidates(docs).collect()
    assert {(r.id, r.start, r.value) for r in rows} == want and len(rows) == len(want) > 0
    words = Counter(w for t in texts.values() for w in re.split(r"""[\s.,;:!?()\[\]{}<>"']+""", t.lower()) if re.fullmatch("[a-z]{3,}", w))
    assert {r.part for r in secrets.dictionary(docs).collect()} == {w for w, n in words.items() if n >= secrets.DICTIONARY_COUNT}


def test_secret_training_rows(spark):
    """Copies of one vector neither leave the sample together nor take the places of others."""
    vector = {c: 0.0 for c in secrets.FEATURES}
    rows = [(k, k, 0.0, {**vector, "length": 16.0}) for k in range(3000)] + [(k, k, 0.0, {**vector, "length": 20.0}) for k in range(3000, 6000)]
    rows += [(k, k, 1.0, {**vector, "length": 40.0}) for k in range(6000, 6025)]
    known = spark.createDataFrame([(a, b, y, *v.values()) for a, b, y, v in rows], ["_key", "start", "label", *vector])
    got = secrets.training_rows(known, 100).collect()
    n = Counter((r.label, r.length) for r in got)
    assert n[1.0, 40.0] == 25 and n[0.0, 16.0] + n[0.0, 20.0] == 75 and min(n[0.0, 16.0], n[0.0, 20.0]) > 20
    assert math.isclose(sum(r.weight for r in got if not r.label), 6000) and sum(r.weight for r in got if r.label) == 25
    assert len({(r._key, r.start) for r in got}) == 100


def test_secrets_with_few_training_rows(spark):
    """Far fewer training rows than copies of one vector: card numbers stay, keys go."""
    key, card = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "4952935900253052"
    rows = [(k, f'card {card} of the owner', "src") for k in range(400)]
    rows += [(1000 + k, f'token = "{key[k:] + key[:k]}"', "src") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.stage(secrets.described(secrets.candidates(docs), secrets.dictionary(docs)), "described")
    for most in (6, 12, 20):
        got = secrets.judged(found, secrets.evident_findings(found), most).collect()
        assert {(r.id >= 1000, r.is_secret) for r in got} == {(True, True), (False, False)}, most


def test_secrets_without_a_name(spark):
    """Keys in prose, lists and tables, and unquoted values, are secrets; numbers, words and named hashes are not."""
    rng = random.Random(8)

    def run(n, of="0123456789abcdef"):
        return "".join(rng.choice(of) for _ in range(n))

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = {100: "AKIA" + run(16, letters), 101: "ghp_" + run(36, letters + "0123456789abcdef"), 102: run(40), 103: "Tr0ub4dor", 104: run(32)}
    rows = [(k, f'the garden path token = "{run(40)}" and card {4952935900253052 + k} here', "src") for k in range(40)]
    rows += [(k + 40, f"commit {run(40)} of the garden path", "src") for k in range(20)]
    rows += [(100, f"please use {keys[100]} for now", "src"), (101, f"- one\n- {keys[101]}\n- two", "src"),
             (102, f"for example {keys[102]} was pasted", "src"), (103, f"password={keys[103]}.", "src"), (104, f"| a | {keys[104]} |", "src"),
             (105, "the-garden-path-to-the-garden-2024 was read", "src")]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.value for r in found if r.doc_id >= 100 and r.is_secret} == keys
    assert {r.doc_id for r in found if r.doc_id == 105 and not r.is_secret} == {105}
    assert not any(r.is_secret for r in found if 40 <= r.doc_id < 60 or r.value.isdigit())
    assert secrets.dictionary(spark.createDataFrame([("word other word",), ("word é",)], "text string")).collect() == [("word",)]


def test_bpe_equals_the_library(docs, texts):
    rules, library = bpe.Rules(open(BYTES, encoding="utf-8").read()), Tokenizer.from_file(BYTES)
    rng = random.Random(1)
    parts = [*"ab'stre vd lm\n\t  '\"19²½Ⅷé中文🙂_-.,!", " ", "　", "'re", "'ll", "<|endoftext|>", "aaaa", "    ", "\r\n", " 's"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    some += ["", " ", "'", "a'", "'s", "x" * 5000, " " * 300, "ab" * 3000, *list(texts.values())[:60]]
    got = bpe.encode_texts(some, rules)
    for text, ids, want in zip(some, got, library.encode_batch(some, add_special_tokens=False)):
        assert ids.tolist() == want.ids
        assert bpe.decode_ids(ids, rules) == library.decode(want.ids, skip_special_tokens=False)
    row = bpe.encode_digests(docs, BYTES).head()
    ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_token_files(spark, docs, texts, tmp_path):
    for n in (0, 1, 3, 4, 5, 1000):
        x = (np.random.default_rng(n).integers(0, 1 << 32, n) >> np.random.default_rng(n).integers(0, 32, n)).astype(np.uint32)
        assert (tokenids.unpack(*tokenids.pack(x), n) == x).all()
    tokenids.write(docs, WORDS, str(tmp_path / "ids"))
    library, start = Tokenizer.from_file(WORDS), 0
    rng = random.Random(2)
    parts = [*"ab'stre VD lm\n\t  '\"19²½Ⅷéÿßñ×ªµÉÈÿ中文🙂_-.,!\x00\x1c\x85\xa0İΣσ\u0301<>/w", "'re", "'LL", "<|endoftext|>", "</w>", "A\u0301", "\r\n"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    some += ["".join(rng.choice("ab'stREdé.,19 \nÜß<>/w") for _ in range(rng.randrange(60))) for _ in range(1000)]
    coder = tokenids.WordCoder(open(WORDS, encoding="utf-8").read())
    for text, ids, want in zip(some, coder.encode([t.encode() for t in some]), library.encode_batch(some, add_special_tokens=False)):
        assert ids.tolist() == [*want.ids, 1], text
    got = {r.doc_id: r for r in tokenids.read(spark, str(tmp_path / "ids")).collect()}
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert got[d].ids == ids.tolist()
        start += len(ids)


def test_hmm_recursions():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    parts = [rng.integers(0, 5, n) for n in (4, 1, 6, 3)]
    start, move, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for x in parts:
        paths = {}
        for z in itertools.product(range(3), repeat=len(x)):
            p = m.start[z[0]] * m.emit[x[0], z[0]]
            for i in range(1, len(x)):
                p *= m.move[z[i - 1], z[i]] * m.emit[x[i], z[i]]
            paths[z] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for i, s in enumerate(z):
                emit[x[i], s] += p / total
                if i:
                    move[z[i - 1], s] += p / total
    assert np.allclose(hmm.log_likelihoods(parts, m), logs)
    for got, want in zip(hmm.expected_counts(parts, m), (start, move, emit)):
        assert np.allclose(got, want)


def test_hmm_scores(spark, docs, texts, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op4_hidden_markov_lm"](spark, sf_dir).collect()}
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for d, r in got.items() if held[d]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"<[^>]*$", "", (r.html or "").partition("<article>")[2].partition("</article>")[0])
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)\s*>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_site_templates(spark):
    def page(k):
        return (k, f"http://Host.com:80/{k}", "<body><div class=x><div>Follow this site</div><section><h2>Page</h2><p>Own text of page "
                f"{k} with enough words<p>and a <b>sec</b>ond&nbsp;&amp; last<br>one {k}</section><div id='comments'><p>nice</div></div>")

    rows = [page(k) for k in range(12)] + [(k, f"http://rare.com/{k}", "<div>Follow this site</div><p>all of it stays here</p>") for k in (50, 51)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[3] == "Page\nOwn text of page 3 with enough words\nand a second & last one 3"
    assert got[50] == "Follow this site\nall of it stays here"


def test_html_class_words(spark):
    """Class words drop whole parts only by a whole token, and never what holds the article."""
    def rows():
        for attrs in ("class='page has-sidebar'", "class='page sidebar'", "id=header"):
            yield f"<body {attrs}><p>the text</p><div class='x ad'>buy</div></body>"
        yield "<body><article class='post related'><p>the text</p><div class=comments>nice</div></article></body>"
        yield "<body><main class='no-banner'><p>the text</p></main><div>more</div></body>"
        yield "<body><main class='banner'><p>the text</p></main></body>"
        yield "<body><div id='content-with-comments'><p>the text</p></div></body>"
        yield "<body><div class='widget'><article><p>the text</p></article></div><p>end</p></body>"
        yield "<body><div class='widget'><div><main><p>the text</p></main></div></div><p>a long end of the page</p></body>"
        yield "<main><p>the text</p><div class='comments'><article>nice</article></div></main>"

    pages = [(k, f"http://h{k}.com/", x) for k, x in enumerate(rows())]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {k: "the text" for k, _, _ in pages}


def test_templates_of_whole_pages(spark):
    """A box on few pages of a host, one longer than the text, and one that is elsewhere outside the article, go."""
    box, long = "<div><p>Notice of one section</p></div>", f"<section><p>{'Long notice ' * 9}</p></section>"
    rows = [(k, "http://a.com", f"<article><p>text {k}</p>{box if k < 6 else ''}{long if k < 5 else ''}</article>") for k in range(40)]
    rows += [(k, "http://b.com", f"<article><p>text {k}</p>{box if k < 102 else ''}</article>{box}") for k in range(100, 108)]
    rows += [(k, "http://c.com", f"<article><div><p>same text</p></div></article><div>{k}</div>") for k in range(200, 208)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {k: "same text" if k >= 200 else f"text {k}" for k, _, _ in rows}


READ = {
    "<article><p>one</p><svg-icon></svg-icon><p>two</p></article>": "one\ntwo",
    "<title-bar>x</title-bar><article><p>y</p></article>": "y",
    "<article><template-x>a</template-x><style-guide>b</style-guide></article>": "a\nb",
    "<main><h1>Head</h1><p>intro</p><article><p>teaser</p></article><p>body text long</p></main>": "Head\nintro\nteaser\nbody text long",
    "<main><p>a</p><article><p>the article itself</p></article></main>": "the article itself",
    "<article data-u=/x/><p>keep</p></article><p>no</p>": "keep",
    "<article><p>" + "text " * 20 + "</p><div class='cookie-banner'>c</div><div class='comment-list'>d</div><div class='ad-slot'>e</div>"
    "<div id='site-footer'>f</div><article class=comment>g</article><div hidden>h</div><div class='entry-header'>Title</div></article>": ("text " * 20).strip() + "\nTitle",
    "<article><div class='has-sidebar'>a</div><div class='no-ads'>b</div><div class='ad-slot'>more than a third of it</div></article>": "a\nb\nmore than a third of it",
    "<p>a<script>x</script>b<SCRIPT>if (a<b) '</p>'</script >c": "abc",
    "<a title=\"x>y\">link</a><p it's>don't</p><!-- a > b -->!<!doctype x>?<p>cut<a href=": "link\ndon't\n!?\ncut",
    "<textarea>never closed <p>text": "",
}


def test_read_page():
    for page, want in READ.items():
        assert "\n".join(line for line, _ in html.read_page(page)[0]) == want, page


@pytest.mark.parametrize("page", ["<script" * 140_000, "<script>" * 120_000, "<div>x" * 170_000, "<b>" * 100_000 + "<p>x" * 100_000, "<div class='ad-slot'>x" * 50_000,
                                  "<div>" * 80_000 + "</i>" * 80_000, "<a b=\"c'" * 100_000 + ">", "&" * 900_000, "<!--" * 200_000, "</script" * 100_000])
def test_broken_and_nested_pages_are_read_in_one_pass(page):
    start = time.process_time()
    html.read_page(page)
    assert time.process_time() - start < 8


def test_counting_decides_what_no_list_names(spark):
    """Boxes without telling names, of sections and of whole hosts; passages shared by few pages of a large host stay."""
    box, tip, quote = "<div><p>Read on with us</p></div>", "<section><p>Of this section</p></section>", "<div><p>A quoted passage</p></div>"
    rows = [(k, f"http://a.com/{'x' if k % 4 == 0 else 'y'}/{k}/p", f"<article><h1>h{k}</h1>{box}<p>text {k}</p>{tip if k % 4 == 0 else ''}{quote if k < 6 else ''}</article>")
            for k in range(400)]
    got = html.cleaned(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    for r in got:
        k = r.page.page_id
        assert r.text == f"h{k}\ntext {k}" + ("\nA quoted passage" if k < 6 else "")
        assert r.removed == 1 + (k % 4 == 0)


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_strings(spark, docs, texts, batches):
    extra = {900_000: "a" * 1000, 900_001: "ab" * 99 + "a", 900_002: "ab" * 100, 900_003: "é" * 150, 900_004: "b" + "é" * 120}
    every = {**texts, **extra}
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    seen = Counter(b[i : i + 200] for b in (t.encode() for t in every.values()) for i in range(len(b) - 199))
    for r in suffixes.repeated_strings(rows, batches).collect():
        b = every[r.doc_id].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), len(turns) // 2)
        assert r.kept == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.spans == turns.tolist()


def test_licenses(spark, docs, texts):
    found = licenses.scan(docs, licenses.default_templates(spark)).collect()
    got = Counter((r.doc_id, r.license) for r in found if r.coverage == 1)
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"):
        for d, t in texts.items():
            assert got[d, name] == t.count(licenses.TEMPLATES[name].rstrip("."))
    header = licenses.TEMPLATES["GPL-3.0-header"].replace("/", " ").split()
    changed = header[:10] + header[12:30] + ["quite", "new", "words"] + header[30:]
    rows = [(1, "before " * 7 + " ".join(changed) + " after" * 5), (2, "under the terms of the agreement")]
    r = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), licenses.default_templates(spark)).collect()
    assert [(x.doc_id, x.license, x.n_matched, x.start_word) for x in r] == [(1, "GPL-3.0-header", len(header) - 2, 7)]


def test_licenses_beside_each_other(spark):
    """Every copy of a notice is found, however close the next one is."""
    rows, want = [], {}
    for name in ("MIT", "CC-BY-NC-4.0", "Apache-2.0"):
        n = len(re.findall("[a-z0-9]+", licenses.TEMPLATES[name].lower()))
        for copies in (1, 2, 3, 20):
            for before in (0, 3):
                want[len(rows)] = [(name, before + n * k, before + n * (k + 1)) for k in range(copies)]
                rows.append((len(rows), "word " * before + "\n".join([licenses.TEMPLATES[name]] * copies)))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), licenses.default_templates(spark)).collect()
    got = {k: sorted((r.license, r.start_word, r.end_word) for r in found if r.doc_id == k and r.coverage == 1) for k in want}
    assert got == want


def test_licenses_by_shuffle(spark, docs, monkeypatch):
    first = sorted(map(tuple, licenses.scan(docs, licenses.default_templates(spark)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, licenses.scan(docs, licenses.default_templates(spark)).collect())) == first


def test_repeats_that_end_inside_runs(spark):
    """Texts glued from shared passages of all lengths around 200 bytes, so that repeats begin and end at every offset."""
    rng = random.Random(12)

    def noise(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    shared = [noise(n) for n in (150, 199, 200, 201, 215, 260, 330, 700)] + ["xy" * 160]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)
            a = rng.randrange(0, 40)
            parts += [noise(rng.randrange(0, 90)), p[a : len(p) - rng.randrange(0, 40)]]
        texts.append("".join(parts))
    texts += texts[:3] + [shared[-2]] * 5
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = suffixes.repeated_strings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts)
    for r in got:
        gone = np.zeros(len(texts[r.doc_id]), bool)
        for i in range(len(gone) - 199):
            if seen[texts[r.doc_id][i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert r.n_removed == gone.sum() and r.spans == np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()


def test_links_between_components_join_them_without_solving_them_again(spark):
    from roamlog.llm import links

    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 21), (30, 31)]
    labels = links.stage(links.components(spark.createDataFrame(edges, "a long, b long")), "labels")
    more = spark.createDataFrame([(3, 12), (21, 40), (41, 40), (2, 1), (50, 51), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in links.joined(labels, more).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 10, 11, 12)}, **{i: 20 for i in (20, 21, 40, 41)}, 30: 30, 31: 30, 50: 50, 51: 50}
    none = spark.createDataFrame([], "a long, b long")
    assert {r.id: r.component for r in links.joined(labels, none).collect()} == {r.id: r.component for r in labels.collect()}
    assert links.joined(links.stage(links.components(none), "labels"), none).count() == 0
