"""Pages, conversations, the classifier, the pipeline and the registered SQL."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest
from relflow.llm import chat, entries, html_text, quality_model, warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_warc_round_trip_over_any_ranges(spark, tmp_path, size):
    rows = [(1, "http://a", "\x1f\u008b\x08" * 40), (2, None, None), (3, "u\r\nInjected: x", ""), (4, "w", "x" * 70_000), (5, "w", "x" * 70_000), (None, "z", "q"), (6, "z", "q"), (7, "v", "WARC/1.1\r\n\r\n"), (7, "v", "WARC/1.1\r\n\r\n")]
    manifest = warc.write(warc.with_revisits(spark.createDataFrame(rows, PAGES)), str(tmp_path), archive_bytes=500)
    got = warc.read(manifest, size).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    have = {}
    for r in got:
        have.setdefault(r.page_id, []).append(r)
    for i, _, h in rows:
        data = (h or "").encode()
        for r in have[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(rows)  # what a revisit names is the record it repeats
    for r in got:
        if r.record_type == "revisit":
            target = by_id[r.target_id]
            assert (target.page_id, target.url, target.payload_digest) == (r.refers_to, r.target_uri, r.payload_digest)


def test_warc_urls_of_any_length(spark, tmp_path):
    r = random.Random(0)
    urls = ["data:" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n)) for n in (300, 95_000, 300_000)] + ["u" * 3_000_000]
    manifest = warc.write(warc.with_revisits(spark.createDataFrame([(i, u, "same") for i, u in enumerate(urls)], PAGES)), str(tmp_path))
    got = warc.read(manifest, 50_000)
    assert {x.page_id: x.url for x in got.collect()} == dict(enumerate(urls))
    warc.whole(manifest, got)
    with pytest.raises(ValueError):
        warc.whole(manifest, got.filter("page_id <> 1"))


def test_warc_other_columns_and_small_payloads(spark, tmp_path):
    rows = [(1, "u", "long enough", "f", 1), (2, "v", "long enough", "f", 2), (3, "u", "ab", "f", 3), (4, None, "ab", "f", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __file string, digest long")
    manifest = warc.write(warc.with_revisits(df, min_revisit=5), str(tmp_path))
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read(manifest).collect()) == [(1, "u", "response", None), (2, "v", "revisit", 1), (3, "u", "response", None), (4, None, "response", None)]


def test_warc_ignores_unfinished_and_empty(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.read(warc.write(warc.with_revisits(none), str(tmp_path))).count() == 0
    (tmp_path / "left.open").write_bytes(b"junk")
    manifest = warc.write(warc.with_revisits(spark.createDataFrame([(1, "a", "b")], PAGES)), str(tmp_path))
    assert [r.page_id for r in warc.read(manifest).collect()] == [1]


def test_warc_reader_resumes_behind_damage(tmp_path):
    good = [warc.record(i, "u", b"p%d" % i * 50, len(b"p%d" % i * 50), hashlib.sha1(b"p%d" % i * 50).hexdigest(), str(i)) for i in range(4)]
    data = good[0] + good[1][:20] + b"\x1f\x8b\x08junk" + good[2] + good[3]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        found = [warc.decode(d)["page_id"] for _, d in warc.records_from(f, len(data), 0, len(data))]
    assert found == [0, 2, 3]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <b>bold</b> x<br>y", "one\n\ntwo bold x y"),
        ("<nav><a href=/>home</a></nav><article><h1>T &eacute;</h1><p>Body,\n  text.</p><aside>no</aside></article><footer>no</footer>", "T é\n\nBody, text."),
        ("<div class='menu'>no</div><div id=content><p>Long enough text, with commas, here.</p><ul><li>a<li>b</ul></div><div class='reader-comments'><p>no, no, no</p></div>", "Long enough text, with commas, here.\n\na\n\nb"),
        ("<article><p>a<script>if (1<2) '</p>'</script>b</p><!-- <p>no</p> --><style>p{}</style></article>", "ab"),
        ("<article><p>a</p><form><p>no</p></form><div class=ad>no</div><p>b</p></article>", "a\n\nb"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_names_of_containers_and_captions():
    for name in ("layout no-sidebar", "content with-sidebar", "sidebar", "page-with-menu"):
        assert html_text.main_text(f"<div class='{name}'><article><p>Body text.</p></article></div>") == "Body text."
    for name in ("discussion", "related-work", "section-tags", "legal"):
        assert html_text.main_text(f"<article><p>a</p><div class='{name}'><h2>T</h2><p>b</p></div></article>") == "a\n\nT\n\nb"
    assert html_text.main_text("<article><p>a</p><figure><img src=x><figcaption>Cap</figcaption></figure><p>E is <math><mi>m</mi><mo>+</mo></math>.</p></article>") == "a\n\nCap\n\nE is m+."
    assert html_text.main_text("<form class=ads><p>All of the page, in a form.</p></form><div class=menu>x</div>") == "All of the page, in a form."
    assert html_text.main_text("<div class='box ads'>" + "no, no. " * 50 + "</div><main><p>b</p></main>") == "b"


def test_html_keeps_short_parts_beside_the_best_container():
    long = [f"Part {i} is long, " + "with words, and commas, " * 12 + "to the end." for i in range(5)]
    p = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    page = f"<body><ul><li><a href=/>home</a></ul><div id=content><div>{p(*long)}</div><h4>Four</h4><div>{p('One more.', 'And one.')}</div><dl><dt>Term<dd>Meaning</dl><div><a href=/x>more of this</a></div></div><div><section>{p('A cousin.')}</section></div></body>"
    assert html_text.main_text(page).split("\n\n") == [*long, "Four", "One more.", "And one.", "Term", "Meaning", "A cousin."]


def test_html_on_generated_articles(spark):
    words = [f"word{i}" for i in range(50)]
    want, pages = {}, []
    for i in range(20):
        blocks = [" ".join(words[(i + k) % 50 :][: 5 + k]) + "." for k in range(1 + i % 5)]
        want[i] = "\n\n".join(blocks)
        pages.append((i, "u", "<html><head><title>x</title></head><body><nav><ul><li><a href=/>m</a></li></ul></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><footer>f</footer></body></html>"))
    got = html_text.extract(spark.createDataFrame(pages, PAGES))
    assert {r.page_id: r.text for r in got.collect()} == want and got.columns == ["page_id", "url", "text", "n_chars"]


def test_html_deep_and_broken_markup():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"
    assert html_text.main_text("</p></div><p>a</b></i>") == "a"
    assert html_text.main_text("<p>a<b") .startswith("a")


@pytest.mark.parametrize("piece", ["<a", "<a ", "<div>x", "<p><b>", "<p don't>First. ", "<p a=\"", "<ul><li>", "</x><div>", "<", "<!--", "<div class=ad>", "<td>x", "<script>", "&amp"])
def test_html_takes_linear_time(piece):
    def seconds(n):
        page = piece * (n // len(piece))
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    assert seconds(400_000) < 5 and seconds(400_000) < 11 * seconds(100_000) + 0.3


def test_html_attributes_and_quotes():
    of = html_text.main_text
    assert of("<p don't>First para.</p>") == "First para."
    assert of('<p title="a>b" class=x/>One</p>') == "One"
    assert of('<p class="x>Lost quote.</p>') == "Lost quote."
    assert of("<p>a < b <3 c</p>") == "a < b <3 c"
    assert of("<p>a<!-->b<!-- no -->c<!doctype x>d<?x?>e</>f</p>") == "abcdef"
    assert of("<div>" * 600 + "deep" + "</div>" * 600 + "<p>after</p>").split("\n\n")[0] == "deep"


def _brute_text(tree):
    """The scorer by its definition: trees of (tag, children), every sum taken over a container's own blocks."""
    blocks, parents, kids = [], {(): None}, {}

    def walk(node, path, link):
        kids[path] = []
        parts = []

        def flush(p=path):
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                blocks.append((text, p, min(sum(len(t) for t, a in parts if a), len(text))))
            parts.clear()

        for i, child in enumerate(node[1]):
            if isinstance(child, str):
                parts.append((child, link))
            elif child[0] == "a":
                parts.append((child[1][0], True))
            else:
                flush()
                parents[(*path, i)] = path
                kids[path].append((*path, i))
                walk(child, (*path, i), link)
        flush()
        tags[path] = node[0]

    tags = {}
    walk(("root", [tree]), (), False)
    points = dict.fromkeys(tags, 0.0)
    for text, p, _ in blocks:
        holder = parents[p] if tags[p] not in ("div", "section", "root") else p
        points[holder] += html_text.points_of(text)
        if parents[holder] is not None:
            points[parents[holder]] += html_text.points_of(text) / 2
    of = lambda p: [n for n, b in enumerate(blocks) if b[1][: len(p)] == p]
    share = lambda p: sum(blocks[n][2] for n in of(p)) / max(1, sum(len(blocks[n][0]) for n in of(p)))
    held = [p for p in tags if of(p)]
    if not held:
        return ""
    score = {p: points[p] * (1 - share(p)) for p in held}
    best = max(held, key=lambda p: (score[p], -len(of(p)), [-x for x in p]))
    top = max(score.values())
    keep, at = set(of(best)), best
    while parents[at] is not None:
        for other in kids[parents[at]]:
            if other != at and other in score and (score[other] >= max(10, 0.2 * top) or share(other) < 0.25):
                keep.update(of(other))
        at = parents[at]
        keep.update(n for n, b in enumerate(blocks) if b[1] == at and b[2] == 0)
    return "\n\n".join(blocks[n][0] for n in sorted(keep))


def test_html_scores_as_by_definition():
    r = random.Random(3)
    words = ["some", "words,", "more", "text.", "and,", "so", "on"]

    def text():
        return " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))

    def tree(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            pick = r.random()
            if depth and pick < 0.5:
                out.append((r.choice(["div", "section"]), tree(depth - 1)))
            elif pick < 0.85:
                out.append(("p", [text(), ("a", [text()])] if r.random() < 0.3 else [("a", [text()])] if r.random() < 0.4 else [text()]))
            else:
                out.append(text())
        return out

    page = lambda x: x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(page, x[1])) + f"</{x[0]}>"
    ties = 0
    for _ in range(300):
        t = ("div", tree(3))
        ties += html_text.main_text(page(t)) != _brute_text(t)
    assert ties == 0


def test_html_empty_table_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old", 7, "k"), (1, "<p>a</p>", "old", 7, "k"), (None, None, "x", None, None)], "page_id long, html string, text string, n_chars long, `__page` string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "__page", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "k", "a", 1), (1, "k", "a", 1), (None, None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_chat_template_reverses():
    for t in ["a\\n<|x|>\\\\|", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "<\\|", "", "<<||>\\n|n", "\n\n"]:
        one, lo, hi = chat.render(t, t)
        assert chat.parse(one) == [(t, t)] and chat.unescape(one[lo:hi]) == t
        assert one.count(chat.START) == one.count(chat.END) == 1


def test_chat_prefixes(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", None), (1, 3, "assistant", "a2"), (1, 4, "user", "end"), (2, 0, "system", "s"), (None, 1, "assistant", "x"), (None, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = sorted(chat.expand(df).collect(), key=lambda r: (r.conv_id or 0, r.example))
    one = [r for r in ex if r.conv_id == 1]
    assert [r.n_turns for r in one] == [2, 4, 5] and [r.text[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in one] == ["a1", "a2", None]
    assert one[1].text.startswith(one[0].text) and one[2].text.startswith(one[1].text)
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    assert back[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\na1\nuser\n\nassistant\na2\nuser\nend\n").hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256(b"a1a2").hexdigest() and back[2].loss_chars == 0 and back[None].n_turns == 2
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0
    stored = chat.read_back(chat.expand(df).orderBy("text"), ordered=False)
    assert {r.conv_id: r for r in stored.collect()} == back


def test_chat_ties_repeats_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, 0, "user", "a", 2), (1, 1, "assistant", "<|" * 50_000 + "\\", 3), (2, None, "assistant", "x", 4), (2, 5, "assistant", None, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example long")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    assert back[1].turns_sha256 == hashlib.sha256(("user\na\nuser\na\nuser\nb\nassistant\n" + "<|" * 50_000 + "\\\n").encode()).hexdigest()
    assert (back[1].loss_chars, back[2].n_turns, back[2].loss_chars) == (100_001, 2, 1)


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.train(docs, labels)
    score, y = model["held_out"]
    good, bad = score[y == 1], score[y == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    out = quality_model.score(docs, model)
    assert out.count() == docs.count()
    assert out.join(labels.filter("quality = 1"), "doc_id").filter("not kept").count() <= 0.03 * labels.filter("quality = 1").count()


def test_calibration_gives_the_shares_it_says():
    r = np.random.default_rng(0)
    y = (r.random(20_000) < 0.3).astype(int)
    views = [2 * (2 * y - 1 + r.normal(0, 1.5, y.size)) + 1, 9 * (2 * y - 1 + r.normal(0, 3, y.size))]
    platt, top = quality_model.calibrate([z[:10_000] for z in views], y[:10_000])
    score = quality_model.combine([z[10_000:] for z in views], platt, top)
    for lo in np.arange(0, 1, 0.2):
        at = (score >= lo) & (score < lo + 0.2)
        assert at.sum() < 200 or abs(y[10_000:][at].mean() - score[at].mean()) < 0.05


def test_classifier_odd_tables(spark):
    kinds = "doc_id long, text string, source string, lang string, n_chars long, score double, t string"
    docs = spark.createDataFrame([(i // 2, None if i % 7 == 0 else "good words, in lines.\n" * (i % 5) if i % 3 else "x $$ " * (i % 9), None, "en", None, 1.0, "t") for i in range(120)] + [(None, "a", "s", None, 3, None, None)], kinds)
    labels = spark.createDataFrame([(i // 2, int(i // 2 % 3 > 0), i) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for model in (quality_model.train(docs, labels), quality_model.train(docs.limit(0), labels)):
        out = quality_model.score(docs, model)
        assert out.count() == 121 and out.filter("score is null or kept is null").count() == 0
        assert out.select("doc_id", "score").distinct().groupBy("doc_id").count().count() == 61
        assert quality_model.score(docs.limit(0), model).count() == 0


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.score(docs, quality_model.train(docs, none)).collect()
    assert all(r.kept and r.score == 0.5 for r in rows) and len(rows) == 2
    assert np.isfinite(quality_model.text_features("\ud800 a" * 3)).all() and not quality_model.text_features("").any()


def test_cotraining_takes_part_of_all_unlabelled(spark):
    rows = [(i, "good words, in a row. " * (1 + i % 7) if i % 2 else "#$% || 99 " * (1 + i % 7), "en", f"s{i % 2}", i % 900) for i in range(9_500)]
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1_000)], "doc_id long, quality int")
    told = quality_model.train(docs, labels, max_labelled=600)["told"]
    assert told["unlabelled"] == 9_500 - 1_000 + 1  # none left out, and no labelled one beyond the sample
    for n, weight in zip(told["pseudo"], told["weights"], strict=True):
        assert 1_600 < n <= 4 * 0.05 * 8_501 and 0 < weight * n <= 300  # four rounds over all; more than a pool of 8000 could give to one view


def test_cotraining_is_the_fit_over_all_rows(spark, monkeypatch):
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600)
    views = [(r.normal(size=(600, k)) + y[:, None]).astype(np.float32) for k in (5, 3)]
    at, rest = slice(0, 100), slice(100, 600)
    rows = [(t.tobytes(), m.tobytes(), int(h)) for t, m, h in zip(views[0][rest], views[1][rest], r.integers(-(2**62), 2**62, 500), strict=True)]
    monkeypatch.setattr(quality_model, "STEPS", 12)
    pool = spark.createDataFrame([(bytearray(t), bytearray(m), h) for t, m, h in rows], "t binary, m binary, h long").repartition(7)
    models, told = quality_model.cotrain([v[at] for v in views], y[at], pool, rounds=1, per_round=0.2)
    first = [quality_model.fit(v[at], y[at].astype(float), ridge=k) for v, k in zip(views, (0.3, 3.0), strict=True)]
    free, base, most = np.ones(500, bool), y[at].mean(), 100
    for v in (0, 1):
        z = quality_model.logits(views[v][rest], first[v])
        take = []
        for sign, n in ((-1, int(most * (1 - base))), (1, int(most * base))):
            sure = np.flatnonzero(free & (sign * z >= np.log(19)))
            take.append(sure[np.argsort(-sign * z[sure])][:n])
        free[np.concatenate(take)] = False
        o, n = 1 - v, sum(map(len, take))
        x = np.vstack([views[o][at], views[o][rest][np.concatenate(take)]])
        t = np.concatenate([y[at], np.zeros(len(take[0])), np.ones(len(take[1]))])
        weight = np.r_[np.ones(100), np.full(n, min(0.5, 50 / n))]
        want = quality_model.fit(x, t.astype(float), weight, ridge=(0.3, 3.0)[o])
        assert abs(told["pseudo"][o] - n) <= 2 and np.abs(models[o] - want).max() < 0.05
    assert quality_model.cut_at(np.array([4, 0, 3]), 5) == (0, 0.5) and quality_model.cut_at(np.array([4, 0, 3]), 9) == (-1, 0.0)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from relflow.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
        before = docs if name == "pii" else None
        if before is not None:
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_matches_sql(name, same):
    same(entries.queries()[name], entries.oracle_sql()[name])
