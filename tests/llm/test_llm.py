"""The operators against brute force, round trips and held-out rows, on small tables with nulls, empty and long texts, ties,
repeated rows, no rows, and further columns with names that clash."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, common, langid, lm, media, mixing, neardup, packing, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


EN = "the cat sat on the mat and then it ran to the house of the old man with a big dog in the rain".split()
FR = "le chat est sur la table et puis il court vers la maison de la vieille dame avec un chien noir".split()


def rows():
    rng = np.random.default_rng(5)
    out = []
    for k in range(60):
        pool, lang = (EN, "en") if k % 3 else (FR, "fr")
        n = 40 if k % 7 else 400
        out.append([k, " ".join(rng.choice(pool, n)) + ("." if k % 2 else "\nIdiot!"), lang, ("a", "b", None)[k % 3] if k % 10 else "hot"])
    base = " ".join(f"w{i}" for i in range(300))
    for k in range(12):
        out.append([100 + k, base.replace(f"w{20 * k} ", "changed "), "en", "hot"])
    out += [[None, None, None, None], [200, "", "en", "b"], [201, None, "fr", None], [202, "12 34", "en", "a"], [203, "Ünï cödé \x1c x", "fr", "a"], [204, "long " * 30_000, "en", "hot"], [None, base, None, "hot"]]
    out += [[0, out[0][1], "fr", "hot"], [105, out[65][1], "en", "hot"]]
    return [(i, t, lang, s, len(t or ""), 0.5, "x", 1) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, data, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(data) and set(docs.columns) <= set(got[0].asDict())
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
        open_ -= set(over)
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in got:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_taken <= 2 * r.mix_size
        assert r.mix_target == pytest.approx(target[r.source])
        taken[r.source] += r.mix_taken
    for s in sizes:
        assert taken[s] == math.floor(target[s] + 0.5)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_positions_follow_the_schedule():
    for k, schedule in enumerate(mixing.SCHEDULES):
        pieces = list(mixing._pieces(schedule))
        assert pieces[-1][4] == pytest.approx(1)


def test_media(docs, data, empty):
    got = media.media_columns(docs).collect()
    assert len(got) == len(data)
    by_text = {}
    for r in got:
        payload = media.unwav(bytes(r.media))
        assert len(payload) % 192 == 0 and r.payload_bytes == len(payload) > 0 and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(r.media) and len(r.pair_time) == len(r.pair_hash) == r.n_pairs
        assert by_text.setdefault(payload[: r.n_bytes], r.feature) == r.feature
    assert sorted(r.n_bytes for r in got) == sorted(len((d[1] or "").encode()) for d in data)
    assert media.media_columns(empty).count() == 0


def test_media_query_stores_files_and_arrays(spark, docs, tmp_path, monkeypatch):
    docs.drop("score", "kept", "row").write.parquet(f"{tmp_path}/documents.parquet")
    stored = []
    monkeypatch.setattr(media, "store", lambda df, name: stored.append(common.store(df, name)) or stored[-1])
    got = media.op2_media_columns(spark, str(tmp_path))
    assert len(stored) == 1 and {"media", "pair_time", "pair_hash"} <= set(stored[0].columns)
    want = media.media_columns(docs)
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    assert rows(got) == rows(want.select(got.columns)) == rows(media.media_columns(docs, arrays=False))
    changed = stored[0].limit(1).withColumn("pair_hash", F.slice("pair_hash", 1, 0)).withColumn("pair_time", F.slice("pair_time", 1, 0))
    assert [(r.n_pairs, r.feature) for r in media.described(changed).collect()] == [(0, hashlib.md5(b"").hexdigest())]


def test_fingerprint_blocks():
    x = bytes(np.random.default_rng(0).integers(0, 256, 192 * 2500, dtype=np.uint8))
    want = media.peaks(x)
    media.BLOCK, old = 7, media.BLOCK
    try:
        assert all((a == b).all() for a, b in zip(want, media.peaks(x)))
    finally:
        media.BLOCK = old


def test_packing(docs, data, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_vocabulary())
    got = packing.pack(docs).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    want = collections.defaultdict(list)
    for r in data:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[r[0]].append((k, start, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(empty).count() == 0


def test_plan_beats_best_fit():
    sizes = {1366 - 17 * k: 100 for k in range(10)} | {1400 + k * 13: 70 for k in range(20)} | {2100 + k * 7: 30 for k in range(9)}
    runs = packing.plan(sizes)
    ends = collections.Counter()
    for length, first, last, sequence, offset in runs:
        for k in range(last - first):
            ends[sequence + k] += length
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(k * v for k, v in sizes.items())
    assert len(ends) < len({r[3] + k for r in packing.rounded(sizes, [], 4096, 16, 1, 0) for k in range(r[2] - r[1])})


def brute_statistics(text):
    w = words(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    marked = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_quality(spark, docs, data, empty):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for got in (quality.quality_rules(docs, labels).collect(), quality.quality_rules(docs, labels.limit(0)).collect()):
        want = collections.Counter((d[0], *brute_statistics(d[1])) for d in data)
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels, carry=True).select("row.*").columns == docs.columns


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(1500) > 0.7).astype(float)
    model = quality.fit(x[:1000], y[:1000], [1, 0, 0])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.85
    grid = np.tile(x[:50], (20, 1))
    grid[:, 0] = np.repeat(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.probability(grid).reshape(20, 50), axis=0) >= -1e-12).all()


def test_language(docs, data, empty):
    got = langid.identify_language(docs).collect()
    assert len(got) == len(data)
    right = n = 0
    texts = {d[0]: d for d in data}
    for r in got:
        if r.doc_id is None:
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        text = texts[r.doc_id][1] or ""
        if not any(c.isalpha() for c in text):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id < 60 and r.held_out:
            n += 1
            right += r.lang_pred == texts[r.doc_id][2]
    assert n and right == n
    assert langid.identify_language(empty).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang = 'z'")).collect()} == set()
    assert langid.identify_language(docs, carry=True).select("row.*").columns == docs.columns


def test_forward_sums_all_segmentations():
    pieces = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "▁ab": 6}
    p = np.random.default_rng(2).random((7, 2))

    def brute(w, lang):
        if not w:
            return 1.0
        return sum((p[pieces[w[:k]], lang] if w[:k] in pieces else p[0, lang] if k == 1 else 0) * brute(w[k:], lang) for k in range(1, len(w) + 1) if k == 1 or w[:k] in pieces)

    some = ["▁ab", "▁aab", "▁xabb", "▁"]
    score, _ = langid.forward(*langid.lattice(some, pieces), p)
    assert score == pytest.approx(np.log([[brute(w, 0), brute(w, 1)] for w in some]))
    counts = langid.expected(*langid.lattice(["▁ab"], pieces), p, np.ones((1, 2)))
    h = 1e-6
    q = p.copy()
    q[4, 0] *= 1 + h
    up, _ = langid.forward(*langid.lattice(["▁ab"], pieces), q)
    down, _ = langid.forward(*langid.lattice(["▁ab"], pieces), p)
    assert counts[4, 0] == pytest.approx((up[0, 0] - down[0, 0]) / h, rel=1e-3)


def test_long_pieces_are_summed():
    pieces = langid.vocabulary(langid.public_vocabulary())
    assert max(map(len, pieces)) > 10 and {"▁people", "▁because", "▁should"} <= set(pieces)
    p = np.random.default_rng(6).random((len(pieces) + 1, 2))

    def brute(w, lang):
        sums = [1.0]
        for end in range(1, len(w) + 1):
            sums.append(sum(sums[k] * p[pieces.get(w[k:end], 0), lang] for k in range(end) if w[k:end] in pieces or end - k == 1))
        return sums[-1]

    some = ["▁people", "▁because", "▁responsibilities", "▁x\u4e00\ue000because", "▁"]
    score, _ = langid.forward(*langid.lattice(some, pieces), p)
    assert score == pytest.approx(np.log([[brute(w, 0), brute(w, 1)] for w in some]))
    small = {"▁": 1, "▁people": 2, "p": 3, "e": 4, "o": 5, "l": 6, "people": 7, "abcdefghijklmnop": 8}
    q = np.random.default_rng(7).random((9, 1))
    score, _ = langid.forward(*langid.lattice(["▁people", "abcdefghijklmnop"], small), q)
    each = q[3] * q[4] * q[5] * q[3] * q[6] * q[4]
    assert np.exp(score[:, 0]) == pytest.approx([(q[2] + q[1] * (q[7] + each))[0], (q[0] ** 2 * q[0] ** 2 * q[4] * q[0] ** 6 * q[6] * q[0] ** 2 * q[5] * q[3] + q[8])[0]])
    counts = langid.expected(*langid.lattice(["▁people"], small), q, np.ones((1, 1)))
    assert counts[2, 0] == pytest.approx((q[2] / np.exp(score[0]))[0])


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """In logarithms: the same as by doubles where those reach, as brute force beyond, whatever the strips."""
    pieces = langid.vocabulary(langid.public_vocabulary())
    rng = np.random.default_rng(8)
    p = rng.random((len(pieces) + 1, 2)) * 1e-6

    def brute(w):
        sums = [np.zeros(2)]
        for end in range(1, len(w) + 1):
            terms = [sums[k] + np.log(p[pieces.get(w[k:end], 0)]) for k in range(max(0, end - 20), end) if w[k:end] in pieces or end - k == 1]
            sums.append(np.logaddexp.reduce(terms))
        return sums[-1]

    some = ["▁people", "▁" + "because" * 30, "▁" + "".join(rng.choice(list("aeinrst\u4e00\ue000"), 700)), "▁", "x" * 64, "▁responsibilities"]
    for strip in (langid.STRIP, 1):
        monkeypatch.setattr(langid, "STRIP", strip)
        assert langid.forward_logs(some, pieces, np.log(p)) == pytest.approx(np.array([brute(w) for w in some]))
    short, weights = [some[0], some[3]], np.array([[2.0, 0.0], [1.0, 3.0]])
    places = langid.lattice(short, pieces)
    assert langid.expected_logs(*places, np.log(p), weights) == pytest.approx(langid.expected(*places, p, weights))
    assert langid.runs([25, 26, 90, 200], 60) == [(0, 2), (2, 3), (3, 4)] and langid.runs([], 9) == []


def test_posterior_is_that_of_whole_words():
    """What a text's score is made of, against the model's own numbers, with a word of 300 characters."""
    path = langid.public_vocabulary()
    model = langid.learn([("en", " ".join(EN) + " " + "thehouse" * 40), ("fr", " ".join(FR))], path)
    assert model.probability[1:].sum(axis=0) == pytest.approx(1, abs=1e-4)  # the rest is the pseudo-count of an unknown character
    said = ["the cat " + "lamaison" * 38 + " 12", "le chien", "", "the the"]
    sums = langid.Scorer(model, path).texts([t.encode() for t in said])
    pieces = langid.vocabulary(path)
    for text, row in zip(said, sums):
        logs = sum((langid.forward_logs([langid.marked(w)], pieces, np.log(model.probability))[0] for w in text.split()), np.zeros(2))
        assert row[1] - row[0] == pytest.approx(logs[1] - logs[0], rel=1e-4, abs=1e-4)
        assert row[2] == sum(any(c.isalpha() for c in w) for w in text.split())
    assert sums[1][1] > sums[1][0] and sums[3][0] > sums[3][1]


def test_rare_languages_and_long_texts_are_learned(spark):
    own = sorted(p[1:] for p in langid.vocabulary(langid.public_vocabulary()) if re.fullmatch("▁[a-z]{5,}", p))
    data = [(k, f"{own[k // 2]} " * 20, f"l{k // 2:03}") for k in range(560)]
    data += [(10_000 + k, "zażółć gęślą jaźń " * 8_000, "long") for k in range(6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    assert common.bounded_sample(docs, "lang", 50).select("lang").distinct().count() == 281
    assert common.bounded_sample(docs, "lang", 50).columns == docs.columns
    got = {r.doc_id: r for r in langid.identify_language(docs).collect()}
    trained = {lang for i, _, lang in data if not got[i].held_out}
    assert len(trained) > 256 and "long" in trained
    assert all(got[i].lang_pred == lang for i, _, lang in data if lang in trained)


def test_warc(spark):
    page = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (7, "http://b", None), (8, "http://c", ""), (9, "http://d", "x" * 300_000), (4, "http://e", "WARC/1.1\r\n\r\nContent-Length: 5\r\n"), (5, "http://a/5", "same"), (None, "u", "same"), (None, "u", "alone"), (11, "http://d", "y" * 70_000 + "é")]
    got = warc.warc_round_trip(spark.createDataFrame([(*p, 0) for p in page], "page_id long, url string, html string, payload int")).collect()
    group = collections.defaultdict(list)
    for i, _, h in page:
        group[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in page:
        b = (h or "").encode()
        top = max((x for x in group[h or ""] if x is not None), default=None)
        response = top is None or i == top
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top)] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_chunks_are_the_archive(spark):
    path = common.new_path(spark, "one")
    pages = spark.createDataFrame([(k, f"http://a/{k}", "z" * (k * 1000)) for k in range(40)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.decide(pages), path, chunk=512)
    archives = collections.defaultdict(bytes)
    for r in spark.read.parquet(path).orderBy("archive", "record_no", "chunk_no").collect():
        archives[r.archive] += bytes(r.data)
        assert len(r.data) <= 512
    records = [x for a in archives.values() for x in a.split(b"WARC/1.1\r\n")[1:]]
    assert len(records) == 40 and all(x.endswith(b"\r\n\r\n") for x in records)
    assert sorted(r.payload_bytes for r in warc.read_archives(spark, path).collect()) == [k * 1000 for k in range(40)]


def test_chat(spark):
    said = "</s>[INST] ok [/INST]\\l <<SYS>>"
    turns = [(1, 0, "system", "be\nkind"), (1, 1, "user", said), (1, 2, "assistant", said), (2, 0, "user", None), (2, 1, "assistant", ""), (2, None, None, "first"), (None, 3, "tool>", "<x>"), (-7, 0, "user", said), (-7, 1, "assistant", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    assert set(got) == {1, 2, None, -7}
    for conv, r in got.items():
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, seq long, kind string, role string, text string, target long")).count() == 0


def test_chat_events():
    events = [(0, "message", "user", "hi", None), (1, "message", "assistant", "he", None), (2, "delta", None, "llo", 1), (3, "delta", None, "!", None), (4, "edit", None, "hi there", 0), (5, "regenerate", "assistant", "new", 1), (6, "delta", "x", "odd", 99)]
    assert chat.fold(events) == [("user", "hi there"), ("assistant", "new"), ("x", "odd")]
    text, starts, ends = chat.render(chat.fold(events))
    assert chat.parse(text) == chat.fold(events) and [text[a:b] for a, b in zip(starts, ends)] == ["new"]
    assert not re.search(r"</s>|\[INST\]", chat.escape("a</s>[INST]b")) and chat.unescape(chat.escape("\\l<[\\")) == "\\l<[\\"


def test_chat_blocks_are_the_fold():
    rng = random.Random(5)
    for _ in range(200):
        events, seq = [], None
        for k in range(rng.randrange(1, 40)):
            seq = None if k < 2 and rng.random() < 0.3 else (seq or 0) + rng.randrange(3)
            kind = rng.choice(["message", "message", "delta", "edit", "regenerate", "other", None])
            events.append((seq, kind, rng.choice(["user", "assistant", "system", "x", None]), rng.choice(["<a>", "bc[", None, "d" * 9]), rng.choice([None, (seq or 0) - rng.randrange(4), rng.randrange(40)])))
        events.sort(key=lambda e: (e[0] is not None, e[0] or 0))
        rows = []
        for conv in (1, None):
            for e in events:
                later = [x[4] for x in events if (x[0] is not None, x[0] or 0) >= (e[0] is not None, e[0] or 0) and x[1] in chat.REFERRING and x[4] is not None]
                rows.append((conv, *e, min(later, default=None)))
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])], names=list("abcdefg"))
        want = chat.render(chat.fold(events))[0]
        for most in (0, 20, 10_000):
            got = [r for b in chat.blocks([batch], most) for r in b.to_pylist()]
            for conv in (1, None):
                mine = [r for r in got if r["conv_id"] == conv]
                assert [r["block"] for r in mine] == list(range(len(mine))) and "".join(r["formatted"] for r in mine) == want


def test_chat_long_conversation_in_bounded_memory():
    def batches(n):
        for at in range(0, n, 1000):
            seqs = range(at, at + 1000)
            columns = [[7] * 1000, seqs, ["delta" if s % 2 else "message" for s in seqs], ["assistant"] * 1000, ["x" * 200] * 1000, [s - 1 if s % 2 else None for s in seqs], [s - s % 2 if s % 2 else s for s in seqs]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=list("abcdefg"))

    def peak(n):
        tracemalloc.start()
        (row,) = [r for b in chat.digests(chat.blocks(batches(n), 100_000)) for r in b.to_pylist()]
        assert row["n_turns"] == n // 2 and row["loss_chars"] == n * 200
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(200_000) < 1.3 * peak(100_000)


def test_chat_blocks_by_spark(spark):
    events = [(c, k, "message" if k % 3 else "delta", "user" if k % 2 else "assistant", f"{k}<{c}", k - 1 if k % 6 == 0 else None) for c in (1, 2) for k in range(300)]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, role string, text string, target long")
    blocks = chat.format_chats(df, block=50)
    assert blocks.count() > 20
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    for r in blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "formatted"))), lambda x: x.formatted), "").alias("formatted")).collect():
        assert r.formatted == whole[r.conv_id].formatted == chat.render(chat.fold([e[1:] for e in events if e[0] == r.conv_id]))[0]
    digests = {tuple(r) for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert digests == {tuple(r) for r in chat.read_chats(blocks.orderBy("formatted")).collect()} == {tuple(r) for r in chat.read_chats(blocks, dealt=True).collect()}


def brute_components(data, k, percent):
    sets = []
    for d in data:
        w = words(lower(d[1]))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, d in zip(label, data):
        if d[0] is not None:
            least[x] = min(least.get(x, d[0]), d[0])
    return [(d[0], len(s), least.get(x) if s else d[0]) for d, s, x in zip(data, sets, label)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, data, empty, k, percent):
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_components(data, k, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_without_near_duplicates(docs, data):
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    want = {c for i, n, c in brute_components(data, 5, 80)}
    assert collections.Counter(i for i in ids if i is not None) == collections.Counter(want - {None})


def test_one_row_of_each_group_stays(spark):
    near = [" ".join(f"w{i}" if i != 20 * k else "changed" for i in range(300)) for k in range(1, 5)]
    other = [" ".join(f"v{i}" if i != 20 * k else "changed" for i in range(300)) for k in range(1, 4)]
    third = [" ".join(f"u{i}" if i != 20 * k else "changed" for i in range(300)) for k in range(1, 4)]
    data = [(None, x) for x in (*near, near[0])] + [(7, x) for x in (*other, other[1])] + [(None, third[0]), (9, third[1]), (8, third[2]), (8, third[2])]
    data += [(None, None), (None, None), (None, ""), (5, ""), (5, ""), (6, "alone")]
    left = collections.Counter((r.doc_id, r.text) for r in neardup.without_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert sum(n for (i, t), n in left.items() if t in near) == 1 and sum(n for (i, t), n in left.items() if t in other) == 1
    assert [(i, t, n) for (i, t), n in left.items() if t in third] == [(8, third[2], 1)]
    assert left[(6, "alone")] == left[(5, "")] == 1 and sum(n for (i, t), n in left.items() if i is None and not t) in (1, 2)


def test_hard_buckets(spark):
    """Copies around the threshold: chains of links that no centre sees at once."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(150):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 8), replace=False):
            w[j] = f"x{k}_{j}"
        data.append((k, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in brute_components(data, 3, 85))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (5, 60, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], rng.integers(0, 1 << 63, len(a) // 5, dtype=np.uint64)]))
        s = neardup.sketches([a, b], 2048)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] == s[1]).mean() == pytest.approx(j, abs=0.08) and (s < np.uint64(1 << 63)).all()


def test_toxicity(spark, docs, data, empty):
    labels = spark.createDataFrame([(d[0], int("Idiot" in (d[1] or ""))) for d in data if d[0] is not None and d[0] < 60][:60], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(data)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 60]
    assert held and all(r.predicted == (r.doc_id % 2 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids, y = rng.normal(size=(9, 2 * toxicity.D + 1)), rng.integers(1, 9, (4, toxicity.WINDOW)), np.array([1, 0, 1, 0.0])
    ids[1, 20:] = 0
    x[0] = 0

    def loss():
        gates = toxicity.padded(net.gates(x))
        z = net.pooled(net.states(gates, ids)[0].astype(float), ids)[3]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    g, dx = net.gradients(x, ids, y)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        h = 1e-2
        v[at] += h
        up = loss()
        v[at] -= 2 * h
        down = loss()
        v[at] += h
        assert g[k][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-4), k


def test_windows_cover_every_word():
    ids = [np.arange(1, n + 1) for n in (0, 1, 31, 32, 33, 48, 49, 100)]
    every, first = toxicity.windows(ids)
    last = np.append(first[1:], len(every))
    for x, a, b in zip(ids, first, last):
        assert set(x.tolist()) == set(every[a:b].ravel().tolist()) - {0}


def test_lm(docs, data, empty):
    for hot in (lm.HOT, 5):
        got = lm.score_texts(docs, hot=hot).collect()
        assert len(got) == len(data)
        counts = collections.Counter()
        for d in data:
            if zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 5 != 1:
                counts.update(words(lower(d[1])) + [""])
        total, distinct = sum(counts.values()), len(counts)
        want = collections.Counter()
        for d in data:
            t = words(lower(d[1])) + [""]
            want[(d[0], len(t), sum(counts[x] > 0 for x in t), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t), 4))] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert lm.score_texts(empty).count() == 0


def test_lm_is_normalised():
    m = lm.Model(np.full(lm.CLASSES, 1 / lm.CLASSES))
    flat = np.concatenate([np.full(lm.CONTEXT, lm.CLASSES), [3, 4, 5]])
    total = sum(10 ** m.log10(np.append(flat[:-1], k), np.array([len(flat) - 1]))[0] for k in range(lm.CLASSES))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_trains_on_every_position(spark, data, monkeypatch):
    class Local:
        """What train_model() uses of a frame, in this process, so that what Model.train() is given can be counted."""

        sparkSession = None

        def __init__(self, batches, turns=None):
            self.batches, self.turns = batches, turns

        def where(self, condition):
            turn = next(k for k in range(lm.ROUNDS) if condition._jc.toString() == (F.col("turn") == k)._jc.toString())
            return Local([b.filter(pa.array([t == turn for t in self.turns])) for b in self.batches])

        def select(self, *names):
            return self

        repartition = select

        def mapInArrow(self, f, kind):
            return Local(list(f(iter(self.batches))))

        def toArrow(self):
            return pa.Table.from_batches(self.batches)

    top = ["the", "cat", "", "w1", "le"]
    shared = type("Shared", (), {"value": lm.Words([x.encode() for x in top], np.ones(len(top)), np.zeros(lm.SHARED), np.zeros(lm.SHARED), 5, 5)})
    seen, want = collections.Counter(), collections.Counter()

    def train(self, run, grown, rng):
        some = np.flatnonzero(run[lm.CONTEXT :] < lm.CLASSES) + lm.CONTEXT
        seen.update(map(tuple, run[some[:, None] - np.arange(lm.CONTEXT + 1)].tolist()))
        return len(some)

    monkeypatch.setattr(lm, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(lm.Model, "train", train)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([d[1] for d in data], pa.string())})
    lm.train_model(Local([batch], [k % lm.ROUNDS for k in range(len(data))]), shared, np.full(lm.CLASSES, 1 / lm.CLASSES))
    for d in data:
        ids = [lm.CLASSES] * lm.CONTEXT + [top.index(x) if x in top else lm._class_of(x.encode()) for x in words(lower(d[1])) + [""]]
        want.update(tuple(ids[k - j] for j in range(lm.CONTEXT + 1)) for k in range(lm.CONTEXT, len(ids)))
    assert seen == want


def test_lm_gradients():
    rng = np.random.default_rng(2)
    m = lm.Model(rng.dirichlet(np.ones(lm.CLASSES)))
    pad = np.full(lm.CONTEXT, lm.CLASSES)
    run = np.concatenate([pad, rng.integers(0, 9, 30), pad, rng.integers(0, 9, 20)])
    noise = rng.integers(0, 20, 12)
    at = [k for k in range(lm.CONTEXT, len(run)) if run[k] < lm.CLASSES]

    def loss():
        r, w, q, b = m.p
        total = 0
        for k in at:
            h = sum(r[run[k - 1 - j]] * w[j] for j in range(lm.CONTEXT))
            score = lambda c: h @ q[c] + b[c] - np.log(len(noise) * m.unigram[c])  # noqa: B023, E731
            total += np.log1p(np.exp(-score(run[k]))) + sum(np.log1p(np.exp(score(c))) for c in noise)
        return total / len(at)

    g, n = m.gradients(run, noise)
    assert n == len(at)
    for x, d in zip(m.p, g):
        for place in {tuple(int(rng.integers(s)) for s in x.shape) for _ in range(4)} | {tuple(np.argwhere(np.abs(d) == np.abs(d).max())[0])}:
            old = x[place]
            x[place] = old + 1e-4
            high = loss()
            x[place] = old - 1e-4
            low = loss()
            x[place] = old
            assert d[place] == pytest.approx((high - low) / 2e-4, abs=2e-4, rel=2e-3)


def test_lm_score_is_the_product_of_classes_and_shares(docs, data, monkeypatch):
    """The model before training, so that brute force has the same one; shared classes, unknown words and rare ones occur."""
    monkeypatch.setattr(lm, "train_model", lambda texts, shared, unigram: lm.Model(unigram))
    counts = collections.Counter()
    for d in data:
        if zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 5 != 1:
            counts.update(words(lower(d[1])) + [""])
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda x: (-counts[x], x.encode()))[: lm.OWN])}
    of = lambda w: own.get(w, lm._class_of(w.encode()))
    n, v = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for w, c in counts.items():
        n[of(w)] += c
        v[of(w)] += 1
    r, w_, q, b = lm.Model((n + 0.5) / (n + 0.5).sum()).p
    want = collections.Counter()
    for d in data:
        t = words(lower(d[1])) + [""]
        if len(t) > 1000:
            continue
        ids, total = [lm.CLASSES] * lm.CONTEXT + [of(x) for x in t], 0.0
        for k, x in enumerate(t):
            h = sum(r[ids[k + lm.CONTEXT - 1 - j]] * w_[j] for j in range(lm.CONTEXT))
            logits, c = q @ h + b, of(x)
            total += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10) + (0 if x in own else math.log10((counts[x] + 0.5) / (n[c] + 0.5 * (v[c] + 1))))
        want[(d[0], len(t))] = total
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_texts(docs).collect()}
    assert all(got[k] == pytest.approx(x, rel=1e-4, abs=1e-3) for k, x in want.items())


def test_lm_of_two_corpora_in_one_session(spark):
    for a, b in (("aa", "bb"), ("xx", "yy")):
        ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 != 1][:20]
        got = lm.score_texts(spark.createDataFrame([(k, f"{a} {b} {a}") for k in ids], "doc_id long, text string").coalesce(1)).collect()
        base = 2 * math.log10(40.5 / (80 + 0.5 * 4)) + 2 * math.log10(20.5 / (80 + 0.5 * 4))  # 20 texts of a, b, a and the end
        assert {(r.n_known, round(r.base_score, 6)) for r in got} == {(4, round(base, 6))}


def test_copies_with_common_changes(spark, monkeypatch):
    """A large group of near copies whose changed words come from a small vocabulary: few pairs are compared, no link is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(400):
        w = list(base)
        for j in rng.choice(120, rng.integers(1, 9), replace=False):
            w[j] = f"x{rng.integers(6)}"
        data.append((k, " ".join(w)))
    compared, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, sets, percent: compared.append(pairs.count()) or verified(pairs, sets, percent))
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in brute_components(data, 3, 85))
    assert sum(compared) < 20 * len(data) < len(data) * (len(data) - 1) / 8


def test_prefix_pairs_miss_no_link(spark):
    rng = np.random.default_rng(9)
    sets = [sorted(set(rng.integers(0, 40, rng.integers(1, 30)).tolist())) for _ in range(120)]
    sets += [sorted({*s, int(rng.integers(40, 60))} - {s[0]} if len(s) > 6 else s) for s in sets[:60]]
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<bigint>")
    labelled = spark.createDataFrame([(k, k % 50) for k in range(len(sets))], "node long, label long")
    for percent in (50, 80, 85):
        listed = neardup._prefix_pairs(labelled, table, percent)
        got = {tuple(sorted((r.a, r.b))) for r in neardup._verified(listed, table, percent).collect()}
        want = {(i, j) for j in range(len(sets)) for i in range(j) if i % 50 != j % 50 and 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))}
        assert got == want


def test_without_near_duplicates_keeps_columns_of_any_name(spark):
    data = [(1, "a b c d e f", 99, "x", 1.0), (2, "a b c d e f", 98, "y", 2.0), (3, None, 97, "z", 3.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, neardup_id int, `a.b` string, `row` double")
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [data[0], data[2]]


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 5000, 3, 0, 900, 901, 20_000, 1, 1)] + ["y"] * 700
    seen = []
    run = common.by_batch(lambda: lambda part: seen.append((part.num_rows, part.nbytes)) or part, most=2000)
    out = list(run(iter([pa.RecordBatch.from_pydict({"text": texts[:400]}), pa.RecordBatch.from_pydict({"text": texts[400:]})])))
    assert [t for b in out for t in b.column(0).to_pylist()] == texts
    assert all(rows <= 256 and (rows == 1 or size <= 2000) for rows, size in seen)
