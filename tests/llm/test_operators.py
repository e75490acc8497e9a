"""Operators on Spark: contracts, edge cases and brute force on small tables."""

import itertools
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, components, decontam, htmltext, langid, linededup, neardup, pieces, quality, queries, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_language_id_on_held_out_documents(spark):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    gold = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(gold, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    model = langid.LanguageModel.train(["the cat " * 9] * 11, ["en"] * 11)
    rows = frame(spark, [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "12", None), (None, "the cat", "x")], "doc_id long, text string, score string")
    got = langid.identify(spark, rows, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "und"), (2, "und"), (2, "und"), (3, "und")]
    assert langid.identify(spark, rows.limit(0), model).count() == 0
    assert langid.sample(rows.limit(0).withColumn("lang", F.lit("x")), "text", "lang", "doc_id", 5) == ([], [])


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://com", "com", "", None, "allow"),
        ("http://a.org/b.net/es/", "a.org", "/b.net/es/", None, "allow"),
        ("http://my-casino.org?x=/", "my-casino.org", "", None, "block"),
        ("http://a.org/casino", "a.org", "/casino", None, "allow"),
        ("no url", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert urlfilter.split_url(url) == (host, path)
    ranked = sorted(urlfilter.DEFAULT_RULES, key=lambda r: (-r.explicit, -len(r.label), r.verdict != "block"))
    fits = urlfilter.GlobAutomaton([r.glob for r in ranked]).fits([f".{host}{path}" if host or path else ""])[0]
    first = next((r for r, f in zip(ranked, fits, strict=True) if f), None)
    assert (first.label if first and first.explicit else None, first.verdict if first else "allow") == (rule, verdict)


def test_url_judge_keeps_columns(spark):
    rows = frame(spark, [(1, "http://a.com/", "old"), (1, "http://a.com/", "old"), (None, None, None)], "page_id long, url string, verdict string")
    got = urlfilter.judge(rows)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(r.verdict for r in got.collect()) == ["allow"] * 3
    assert urlfilter.judge(rows.limit(0)).count() == 0


def _shingles(text):
    w = text.lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def _brute_classes(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        union = sum((x | y).values())
        if (not x and not y) or union and sum((x & y).values()) >= 0.8 * union:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(500)]
    rows, i = [], 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = base[:]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    passage = " ".join(rng.choices(vocab, k=60))
    for _ in range(20):
        rows.append((i, passage + " " + " ".join(rng.choices(vocab, k=60))))
        i += 1
    rows += [(i, ""), (i + 1, " "), (i + 2, "x"), (i + 3, "x")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == _brute_classes(rows)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(300):
        copy = base[:]
        for _ in range(3):
            copy[rng.randrange(100)] = f"c{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + k, "the same text here again") for k in range(200)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == _brute_classes(rows)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, None), (None, "a b c"), (5, "a b c"), (6, "other words"), (6, "a B c"), (7, "other words")]
    got = sorted(((r.doc_id or 0), r.class_id) for r in neardup.classes(spark, frame(spark, rows, "doc_id long, text string")).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 2), (3, 3), (5, 1), (6, 1), (6, 1), (7, 1)]
    assert neardup.classes(spark, frame(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates_under_a_common_passage(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup.rare_links, "__defaults__", (block,))
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(75)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(25)])) for i in range(120)]
    for i in range(120, 150):  # near copies of some of them
        ws = rows[i - 120][1].split()
        ws[rng.randrange(100)] = "changed"
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == _brute_classes(rows) and len(set(got.values())) >= 90


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_blocks_of_a_group_lose_no_link(spark, block_bytes):
    rng = random.Random(1)
    sets = {i: sorted(rng.sample(range(14), 8)) for i in range(40)}
    placed = [(7, 40, 40 * 64 if block_bytes > 1 else 6, i, i, np.array(x, np.uint64).tobytes()) for i, x in sets.items()]
    got = neardup.block_links(frame(spark, [(a, b, c, d, e, bytearray(f)) for a, b, c, d, e, f in placed], "bucket long, size long, bytes long, id long, component long, elements binary"), 0.6, 9, block_bytes)
    classes = {r.node: r.component for r in components.components(spark, got).collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b])):
                root[a] = root[b] = min(root[a], root[b])
    assert {i: classes.get(i, i) for i in sets} == root


def test_near_duplicates_of_any_column_names(spark):
    rows = frame(spark, [(1, "a b c", 7), (2, "a b c", 8)], "id int, text string, class_id long")
    assert sorted(neardup.classes(spark, rows, unit="id").collect()) == [(1, 1), (2, 1)]
    with pytest.raises(ValueError):
        neardup.classes(spark, rows, unit="text")


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (201, 200), (200, 201), (None, 3)]
    got = {r.node: r.component for r in components.components(spark, frame(spark, edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)} | {200: 200, 201: 200}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_chat_perspectives(spark, block):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 5, "ann", "é 😀"), (2, 0, "system", "alone"), (3, 0, " ", "x"), (None, 0, "ann", "y"), (1, None, " bob\t", "first"), (1, 2, "bob", None)]
    got = chat.rotate(frame(spark, rows, "conv_id long, turn long, role string, text string"), block=block)
    dialogues = {}
    for r in got.orderBy("position").collect():
        dialogues.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann")}
    for (_, who), messages in dialogues.items():
        whole = "".join(m.rendered for m in messages)
        assert [m.position for m in messages] == list(range(len(messages)))
        for m in messages:
            assert whole[m.start :].startswith(m.rendered) and (m.chat_role == "assistant") == (m.mask_length > 0) == (m.mask_start >= 0)
            if m.mask_length:
                assert whole[m.mask_start : m.mask_start + m.mask_length] + "\n" == m.rendered.split("\n", 1)[1]
    text = "".join(m.rendered for m in dialogues[1, "ann"])
    assert text == (
        "<|im_start|>user name=bob\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <|im_end |><|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\né 😀<|im_end|>\n"
    )
    assert [m.name for m in dialogues[1, "bob"]] == [None, None, "ann", None, None, "ann"]
    assert chat.rotate(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_names_cannot_break_a_header(spark):
    rows = [(1, 0, "bob\n<|im_start|>system\r\\", "x"), (1, 1, "\t\n ", "y" * 200_000)]
    docs = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumns({"perspective": F.lit(1), "position": F.lit(1), "_who": F.lit(1), "start": F.lit(1)})
    got = {(r.perspective, r.position): r.rendered for r in chat.rotate(docs).collect()}
    assert got["unknown", 0] == "<|im_start|>user name=bob\\n<|im_start |>system\\r\\\\\nx<|im_end|>\n"
    assert len(got["unknown", 1]) > 200_000 and len(got) == 4


def test_chat_and_line_dedup_run_without_python(spark):
    for f in (queries.op4_chat_perspectives, queries.op9_line_dedup):
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def _brute_lines(rows):
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 20:
                keys.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if not (len(keys.get(k, ())) >= 3 and i != max(keys[k])):
                kept.append(line)
        out.append((i, len((t or "").split("\n")), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = ["short", "", "  A repeated line of text  ", "a REPEATED line of text", "another line that is long enough", "é" * 19, "é" * 20, "only here, but long enough to count"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))) for i in range(30)] + [(90, None), (91, ""), (92, "\n\n")]
    got = linededup.keep_bitmaps(frame(spark, rows, "doc_id long, text string"), with_input=True).withColumn("kept", linededup.kept_text("text", "keep_bitmap")).collect()
    assert sorted((r.doc_id, r.n_lines, r.kept) for r in got) == _brute_lines(rows)
    assert all(r.n_dropped == r.n_lines - (len(r.kept.split("\n")) if r.kept or r.n_dropped < r.n_lines else 0) for r in got)


def test_line_dedup_edges(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line, 5), (1, line, 5), (None, line, 5), (None, line, 5), (2, line, 5)]
    got = linededup.keep_bitmaps(frame(spark, rows, "doc_id long, text string, n_lines long"), with_input=True)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "keep_bitmap"]
    assert got.agg(F.sum("n_dropped")).first()[0] == 0  # two documents hold it
    rows.append((3, line, 5))
    got = linededup.keep_bitmaps(frame(spark, rows, "doc_id long, text string, n_lines long"))
    assert sorted(((r.doc_id or 0), r.n_dropped) for r in got.collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]
    assert linededup.keep_bitmaps(frame(spark, [], "doc_id long, text string")).count() == 0


def test_line_dedup_of_very_long_documents(spark):
    n = 100_000
    lines = [f"line number {k} of a very long document" for k in range(n)]
    rows = [(i, "\n".join(lines[i:] + ["own line of document %d, all its own" % i])) for i in range(3)]
    took = time.time()
    got = linededup.keep_bitmaps(frame(spark, rows, "doc_id long, text string"), with_input=True).withColumn("kept", linededup.kept_text("text", "keep_bitmap"))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == [
        (0, n + 1, n - 2, "\n".join([*lines[:2], rows[0][1].rpartition("\n")[2]])),
        (1, n, n - 2, "\n".join([lines[1], rows[1][1].rpartition("\n")[2]])),
        (2, n - 1, 0, rows[2][1]),
    ]
    assert time.time() - took < 90


def test_line_dedup_of_clashing_names_and_texts_of_one_id(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"x\n{line}", 5, 6, 7), (1, f"{line}\ny\n{line}", 5, 6, 7), (2, line, 5, 6, 7), (3, f"{line}\nz\n{line}", 5, 6, 7)]
    docs = frame(spark, rows, "_unit long, text string, _lost long, _t long, `a.b` long")
    got = linededup.keep_bitmaps(docs, unit="_unit", with_input=True)
    assert got.columns == ["_unit", "text", "_lost", "_t", "a.b", "n_lines", "n_dropped", "keep_bitmap"]
    kept = got.withColumn("kept", linededup.kept_text("text", "keep_bitmap"))
    assert sorted((r._unit, r._lost, r.n_dropped, r.kept) for r in kept.collect()) == [(1, 5, 1, "x"), (1, 5, 2, "y"), (2, 5, 1, ""), (3, 5, 0, rows[3][1])]
    once = linededup.keep_bitmaps(docs, unit="_unit", with_input=True, repeats=True).withColumn("kept", linededup.kept_text("text", "keep_bitmap"))
    assert [r.kept for r in once.where("_unit = 3").collect()] == [f"{line}\nz"]


def test_html_operator(spark):
    rows = frame(spark, [(1, "u", "<p>Hi  there</p>", "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(rows).collect()}
    assert got == {1: ("Hi there", 8), 2: ("", 0)}
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(5, "u5", "same"), (3, "u3", "same"), (4, None, "é" * 200_000), (7, "u7", None), (6, "u6", ""), (None, "u", "same"), (3, "u3", "same")]
    got = warc.round_trip(spark, frame(spark, pages, "page_id long, url string, html string"))
    by = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got.collect())
    assert by == [(0, 4, "revisit", 3), (3, 4, "response", 0), (3, 4, "response", 0), (4, 400_000, "response", 0), (5, 4, "revisit", 3), (6, 0, "response", 0), (7, 0, "revisit", 6)]
    assert bytes(got.where("page_id = 4").first().payload).decode() == "é" * 200_000
    assert warc.round_trip(spark, frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_warc_minimum_size(spark):
    pages = frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    folder = warc.scratch_path(spark, "t")
    got = warc.read_archives(warc.write_archives(spark, pages, folder, min_dedup_bytes=3), folder)
    assert sorted((r.page_id, r.record_type) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_decontamination_edges(spark):
    item = "one two three four five six seven eight nine ten"
    bench = frame(spark, [(1, item), (1, "ALPHA beta gamma delta epsilon"), (2, None), (None, item), (3, "..."), (4, item)], "item_id long, text string")
    docs = frame(spark, [(1, f"x {item.upper()}, y", "z"), (2, None, "z"), (3, "", "z"), (4, "alpha-beta gamma delta epsilon", "z"), (4, "alpha-beta gamma delta epsilon", "z"), (5, "one two three", "z")], "doc_id long, text string, edits string")
    got = decontam.find_items(spark, docs, bench)
    assert sorted((r.doc_id, r.contaminated, r.item_ids) for r in got.collect()) == [(1, True, [1, 4]), (2, False, []), (3, False, []), (4, True, [1]), (4, True, [1]), (5, False, [])]
    blocks = decontam.find_items(spark, docs, bench, block_bytes=1)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))
    texts = decontam.find_items(spark, docs, bench, with_text=True, block_bytes=60)
    assert texts.columns == ["doc_id", "text", "contaminated", "item_ids", "edits"]
    assert sorted(map(str, texts.drop("text").collect())) == sorted(map(str, got.collect()))
    assert sorted(str(r.text) for r in texts.collect()) == sorted(str(r.text) for r in docs.collect())
    assert not any(r.contaminated for r in decontam.find_items(spark, docs, bench.limit(0)).collect())
    assert decontam.find_items(spark, docs.limit(0), bench).count() == 0


def test_decontamination_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(r[0], r[1]) for r in docs.alias("d").join(bench.alias("b"), F.expr("contains(d.text, b.text)")).select("doc_id", "item_id").collect()}
    got = {(r.doc_id, i) for r in queries.op7_decontamination(spark, SF).collect() for i in r.item_ids}
    assert want and want <= got


def test_decontamination_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(3)
    edited = []  # and passages with up to the allowed edits, planted in documents
    for k in range(120):
        ws = bench[k % len(bench)][1].split()
        for _ in range(rng.randrange(0, int(0.2 * len(ws)) + 1)):
            at = rng.randrange(len(ws))
            ws[at : at + 1] = rng.choice([["changed"], [], [ws[at], "more"]])
        host = (docs[k % len(docs)].text or "").split()
        at = rng.randrange(len(host) + 1)
        edited.append((10_000 + k, " ".join([*host[:at], *ws, *host[at:]])))
    rows = [(r.doc_id, r.text) for r in docs] + edited
    items = decontam.Items([i for i, _ in bench], [t for _, t in bench])
    want = {}
    for i, t in rows:
        h = decontam.words(decontam.plain(pa.array([t or ""])), decontam.ALNUM)[0]
        for k, sequence in enumerate(items.sequences):
            if np.isin(sequence, h).sum() >= len(sequence) - items.bounds[k] and (d := decontam.edit_distance(sequence, h)) <= items.bounds[k]:
                want[i, int(items.ids[k])] = d
    found = decontam.find_items(spark, frame(spark, rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    got = {(r.doc_id, i): d for r in found for i, d in zip(r.item_ids, r.edits, strict=True)}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 100
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_pieces_operator(spark):
    docs = frame(spark, [(1, "Hello  world\né", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello  world\né", "x")], "doc_id long, text string, ids string")
    coded = pieces.encode(docs)
    assert {r.doc_id: (r.ids is None, r.n_tokens > 0, r.round_trip) for r in coded.collect()} == {1: (False, True, True), 2: (True, False, True), 3: (False, False, True)}
    assert sorted(str(r.text) for r in pieces.decode(coded).collect()) == sorted(["Hello  world\né", "None", "", "Hello  world\né"])
    assert pieces.encode(docs.limit(0)).count() == 0


def test_decontamination_beyond_ascii(spark):
    item = "he said that it's a long way - and then: nothing, just \"rain\" and wind"
    typed = "xx he\u00a0said\u2009that it\u2019s a\u3000long way\u2014and then\uff1a nothing\uff0cjust\u201crain\u201dand\u2026wi\u00adnd yy"
    bench = frame(spark, [(1, item), (2, "春眠不覚暁処処聞啼鳥"), (3, "größe über alles naïve façade")], "item_id long, text string")
    docs = frame(spark, [(1, typed), (2, "前の文。そして春眠不覚暁処処聞啼鳥と言った"), (3, "die Größe über alles “naïve” façade"), (4, "春の夜の夢は短い")], "doc_id long, text string")
    got = decontam.find_items(spark, docs, bench)
    assert {r.doc_id: (r.item_ids, r.edits) for r in got.collect()} == {1: ([1], [0]), 2: ([2], [0]), 3: ([3], [0]), 4: ([], [])}


def test_quality_operator(spark):
    clean = "This is a plain sentence of some length, written so that nothing in it repeats and every rule is content."
    rows = [(1, clean, 1), (2, None, 1), (3, "", 1), (4, "word " * 40, 1), (5, " ".join(f"{k * 7919 % 65521:x}{k * 104729:x}" for k in range(200)), 1), (1, clean, 1)]
    got = quality.assess(frame(spark, rows, "doc_id long, text string, kept int"))
    assert {r.doc_id: (r.base_failed, r.kept) for r in got.collect()} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False)}
    assert quality.assess(frame(spark, rows, "doc_id long, text string, kept int").limit(0)).count() == 0


def test_quality_bounds_of_the_corpus(spark):
    stems = "house river morning letter garden window summer market village question answer mountain teacher kitchen winter history machine country station picture".split()
    rng = random.Random(3)
    clean = [(k, " ".join(rng.choices(stems, k=60)), "en") for k in range(300)]
    junk = [(1000 + k, " ".join(w[:3] + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for w in rng.choices(stems, k=60)), "en") for k in range(3)]
    rows = clean + junk
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    gone = lambda d: {r.doc_id for r in quality.assess(d).where("not kept").collect()}
    assert gone(docs) == {1000, 1001, 1002}
    assert gone(docs.union(docs).union(docs).repartition(7)) == {1000, 1001, 1002}
    assert gone(docs.where("doc_id < 1000")) == set()
    assert gone(docs.withColumn("lang", F.lit(None).cast("string"))) == {1000, 1001, 1002}
    assert quality.RankFertility("/opt/tokenizers/byte_bpe_multi_50k.tiktoken").measure([" " * 2_000_000, ""])[0][1] == 0


def test_quality_equals_brute_force(spark):
    import base64
    import math

    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    with open("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = tiktoken.Encoding("r", pat_str=quality.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})

    def entropy(ids):
        return -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.assess(docs.drop("source", "n_chars")).collect()}
    rows = docs.collect()
    layout = {model.PieceToId(p) for p in ("<0x09>", "<0x0A>", "<0x0D>")}
    by = {}
    for r in rows:
        g, text = got[r.doc_id], r.text or ""
        ids, more = model.encode(text), ranks.encode(text, disallowed_special=())
        share = sum(model.IsByte(i) and i not in layout for i in ids) / max(1, len(ids))
        assert g.n_tokens == len(ids) and g.script == quality.scripts([text])[0]
        for a, b in ((g.chars_per_token, len(text) / max(1, len(ids))), (g.byte_share, share), (g.token_entropy, entropy(ids) if ids else 0), (g.chars_per_token_2, len(text) / max(1, len(more))), (g.token_entropy_2, entropy(more) if more else 0)):
            assert abs(a - b) < 1e-9
        if not g.base_failed:
            by.setdefault((g.script, r.lang), []).append(round(g.chars_per_token_2, 3))
    for r in rows:
        g = got[r.doc_id]
        band = quality.BANDS[g.script]
        kept = not g.base_failed and band.least_chars <= g.chars_per_token <= band.most_chars and g.byte_share <= band.most_bytes
        kept = kept and (g.n_tokens < band.entropy_from or min(g.token_entropy, g.token_entropy_2) >= band.least_entropy)
        if kept:
            held = sorted(by[g.script, r.lang])
            at = lambda q: held[math.floor(q * len(held))]
            kept = round(g.chars_per_token_2, 3) >= min(at(quality.TAIL), at(0.25) - quality.FENCE * (at(0.75) - at(0.25)))
        assert g.kept == kept
    assert any(not g.kept and not g.base_failed for g in got.values()) or len(got) < 300


def test_scripts():
    assert quality.scripts(["plain", "naïve façade — “q”", "Привет, мир", "日本語です", "", "123"]) == ["latin", "latin", "cyrillic", "cjk", "latin", "latin"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    texts = docs.select("doc_id", "text").collect()
    counts = dict(zip([r.doc_id for r in texts], quality.base_counts(pa.array([r.text for r in texts], pa.string())).tolist()))
    base = {i for i, c in counts.items() if not (c[0] < 10 or 100 * c[4] > 20 * c[0])}
    assert {r.doc_id for r in kept.collect()} <= base and kept.count() >= 0.98 * len(base)
    lines = stages["line_dedup"](spark, kept, SF)
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted((i, t) for i, _, t in _brute_lines([(r.doc_id, r.text) for r in kept.collect()]))
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = stages["near_dedup"](spark, lines, SF)
    assert {r.doc_id for r in near.collect()} == set(_brute_classes([(r.doc_id, r.text) for r in lines.collect()]).values())
    clean = stages["decontaminate"](spark, near, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()} >= {r.doc_id for r in near.collect() if any(i in r.text for i in items)}
    assert clean.columns == docs.columns
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in clean.collect()} and all(r.round_trip for r in last.collect())


def test_pipeline_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 5, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_keeps_clashing_columns(spark):
    names = ["kept", "script", "n_words", "edits", "n_lines", "class_id", "_lost", "contaminated", "least", "_unit", "id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.schema[-1].dataType == docs.schema[-1].dataType, name
        rows = got.collect()
        assert rows and all(r[n] == f"{k}-{r.doc_id}" for r in rows for k, n in enumerate(names))


def test_scratch_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tessera.llm import _store

    class Cluster:
        def getConf(self):
            return self

        def get(self, key, default=None):
            return None

    cluster = type("S", (), {"sparkContext": type("C", (Cluster,), {"master": "spark://host:7077"})(), "conf": Cluster()})()
    with pytest.raises(ValueError):
        _store.shared_dir(cluster)
    kept = _store.materialise(spark, spark.range(3), "t")
    assert kept.count() == 3
    path = _store._PATHS[kept].removeprefix("file://")
    assert os.path.isdir(path)
    _store.release(kept)
    assert not os.path.exists(os.path.dirname(path))


def test_scratch_tables_of_a_stage_go_once_it_is_written(spark):
    from tessera.llm import _store

    before = _store.live()
    corpus_pipeline.run(spark, SF).count()
    left = _store.live() - before
    assert len(left) == 1 and "encode" in next(iter(left))
