"""The pipeline's stages on small tables."""

import collections
import functools
import hashlib
import zlib

import numpy as np
import pytest

from pagemill.llm import langid, packing

from . import test_llm


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(test_llm.rows(), test_llm.DOCS).drop("score", "kept", "row").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns, name
        before, after = docs.count(), out.count()
        assert after > 0
        if name in ("language_id", "quality_rules", "near_dedup"):
            assert after < before
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_stages_keep_columns_of_any_name(spark, folder):
    """Dots and names that stages use themselves; nulls in any column."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    extra = {"a.b": "1.5D", "row": "'r'", "id": "doc_id + 1", "key": "2", "group": "null", "neardup_id": "99", "mix_size": "-1", "held_out": "'h'", "lang_pred": "'x'", "length": "7"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.expr(e).alias(n) for n, e in extra.items()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[-len(extra) :] == list(extra)
        got = docs.collect()
        assert got and all(r[-len(extra)] == 1.5 and r["neardup_id"] == 99 and r["mix_size"] == -1 and (r["id"] is None) == (r["doc_id"] is None) and r["row"] == "r" for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_empty_table(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def corpus():
    """Three languages, three sources and null, near copies, repeated rows, rows to reject, one long text."""
    rng = np.random.default_rng(11)
    ends = {"en": ("ing", "ness", "th"), "fr": ("eux", "ment", "oir"), "pl": ("szcz", "ować", "ość")}
    pools = {lang: ["".join(rng.choice(list("bcdfglmnprst"), 2)) + "aeiou"[k % 5] + e + str(k) * (k % 9 == 0) for k in range(200) for e in ends[lang]] for lang in ends}
    out, sources = [], ("a", "b", None, "c")
    for k in range(36):
        lang = list(ends)[k % 3]
        w = list(rng.choice(pools[lang], 60 + 11 * k))
        out.append((k, " ".join(w), lang if k % 4 else None, sources[k % 4]))
        if k % 5 == 0:  # copies that differ by one word, and a chain of more changes than a link allows
            for c in range(1, 4):
                w = w[: 20 * c] + ["Changed"] + w[20 * c :]
                out.append((100 + 10 * k + c, " \n".join(w), lang, sources[(k + c) % 4]))
    out += [(None, out[0][1], "en", "a"), out[1], out[1], (900, " ".join(rng.choice(pools["en"], 6000)), "en", "c")]
    out += [(901, None, "en", "a"), (902, "", "fr", "b"), (903, "12 34 , .", "pl", None), (904, "too short a text", "en", "c"), (905, "again and again " * 90, "en", "a"), (906, "mixed " + " ".join(pools["fr"][:40] + pools["en"][:40]), None, "b")]
    return out


def brute_language(rows):
    pieces, path = langid.vocabulary(langid.public_vocabulary()), langid.public_vocabulary()
    learned = sorted((lang, t if len(t.encode()) <= langid.LONGEST else t[: langid.LONGEST // 4]) for i, t, lang, _ in rows if t is not None and lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 5)
    model = langid.learn(learned, path)
    logs, longest = np.log(model.probability), max(map(len, pieces))

    def word(w):
        sums = [np.zeros(len(model.languages))]
        for end in range(1, len(w) + 1):
            sums.append(np.logaddexp.reduce([sums[k] + logs[pieces.get(w[k:end], 0)] for k in range(max(0, end - longest), end) if w[k:end] in pieces or end - k == 1]))
        return sums[-1]

    word = functools.cache(word)

    def keep(text):
        total = model.prior + sum(word("▁" + w.lower()) for w in test_llm.words(text))
        return any(c.isalpha() for c in text or "") and 1 / np.exp(total - total.max()).sum() >= 0.5

    return [r for r in rows if keep(r[1])]


def brute_quality(rows):
    """Labels of one kind: the base rules alone."""
    return [r for r in rows if (s := test_llm.brute_statistics(r[1]))[0] >= 50 and 2 * s[4] <= s[0]]


def brute_dedup(rows):
    sets = []
    for r in rows:
        w = test_llm.words(test_llm.lower(r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for x, r in sorted(zip(label, rows), key=lambda p: (p[1][0] is None, p[1][0] or 0)):
        first.setdefault(x, r)
    return list(first.values())


def brute_mix(rows):
    size = lambda r: len(test_llm.words(r[1]))
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    sizes = {s: sum(size(r) for r in rows if r[3] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= set(over)
    out = []
    for s in order:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest())
        left = int(target[s] + 0.5)
        for r in mine + mine:
            if (n := min(left, size(r))) > 0:
                out.append((r[0], r[1][: list(test_llm.WORD.finditer(r[1]))[n - 1].end()] if n < size(r) else r[1], *r[2:]))
                left -= n
    return out


def brute_pack(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(packing.public_vocabulary()), []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            out.append((i, k, start, len(part), zlib.crc32(part.tobytes())))
    return out


def test_every_stage_against_brute_force(spark, tmp_path):
    """Each stage on its own input, then run(): the rows of the five brute-force stages in a row."""
    import corpus_pipeline

    rows, folder = corpus(), str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, count = spark.read.parquet(f"{folder}/documents.parquet"), collections.Counter
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_language, brute_quality, brute_dedup, brute_mix, None)):
        out = stage(spark, docs, folder)
        if brute is None:
            break
        want = brute(rows)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got = docs.collect()
        assert count((r.doc_id, r.text, r.source) for r in got) == count((r[0], r[1], r[3]) for r in want), name
        assert name != "mix_sources" or all(r.n_chars == len(r.text) for r in got)
        assert name == "mix_sources" or len(want) < len(rows)
        rows = want
    assert len(rows) > 30 and any(r[0] == 900 for r in rows)
    want = count(brute_pack(rows))
    for packed in (out.collect(), corpus_pipeline.run(spark, folder).collect()):
        assert count((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
        at = collections.Counter()
        for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at[r.sequence_id]
            at[r.sequence_id] += r.length
        assert max(at.values()) <= 4096
