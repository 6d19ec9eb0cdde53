"""Language, toxicity, media and the pipeline on small tables."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmill.llm import language, media, packing, simhash, toxicity
from sparkmill.llm.sampling import Least, least_of_each
from sparkmill.llm.scratch import new_path

from .conftest import odd_rows, with_clashes

SYLLABLES = {"aa": "ka to mi ru se no".split(), "bb": "schl ung ver keit pfe zu".split(), "cc": "eau oux tre que ill on".split()}


def speech(lang: str, seed: int, n: int = 60) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(k, speech(lang, k), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language(spark, talk):
    got = language.identify(talk).join(talk.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(180) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark, talk, odd, none):
    model = language.fit(talk)
    rows = [(str(r["doc_id"]), r["lang_pred"], r["score"], r["rejected"]) for r in language.predict(odd, model).collect()]
    assert len(rows) == len(odd_rows())
    und = {str(d) for d, t in odd_rows() if t is None or not any(c.isalpha() for c in t)}
    assert {d for d, lang, _, _ in rows if lang == "und"} == und == {d for d, _, s, _ in rows if s == 0}
    assert all(x for d, _, _, x in rows if d in und)
    strange = spark.createDataFrame([(1, "прстк внмрл збкчт дфгхц " * 20)], "doc_id long, text string")
    assert language.predict(strange, model).first()["rejected"]
    assert language.predict(none, model).isEmpty() and language.fit(none) is None
    assert language.predict(odd, None).where("lang_pred = 'und' and score = 0 and rejected").count() == len(odd_rows())


def test_scores_do_not_depend_on_slices(talk, monkeypatch):
    model = language.fit(talk)
    texts = [speech("aa", 1, 400), "x", speech("bb", 2, 3000), "", speech("cc", 3, 5)]
    want = np.stack([model.sums([t])[0] for t in texts])
    for size in (64, 1000):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.allclose(model.sums(texts), want, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize(("text", "term", "distance", "quoted"), [
    ("you idiot!", "idiot", 0, False), ("an IDIOTT", "idiot", 1, False), ("wortless", "worthless", 1, False), ("w0rthless", "worthless", 1, False),
    ("worhtless", "worthless", 2, False), ('"idiot" is a word', "idiot", 0, True), ("the word idiot", "idiot", 0, True), ("grubber", "grub*", 0, False)])
def test_lexicon(text, term, distance, quoted):
    hits = toxicity.Finder(toxicity.Lexicon(["idiot", "worthless", "grub*", "scum"])).hits(text)
    assert [(h[1], h[2], h[3]) for h in hits] == [(term, distance, quoted)]


@pytest.mark.parametrize(("text", "quoted"), [
    ('he "agreed" then you idiot, don\'t come back', False), ("it's you idiot, don't come", False), ('"yes" you idiot "no"', False), ('yes" you idiot "no', False),
    ("'tis you idiot and don't", False), ('the 6" idiot', False), ("‘agreed’ you idiot, it’s over", False), ("“so” idiot ”", False), ("«oui» idiot, l’heure", False),
    ('"you are an idiot"', True), ("'you idiot'", True), ("“what an idiot,” he", True), ("„du idiot“ und", True), ("« un idiot »", True), ("»idiot«", True), ("‘don’t be an idiot’", True),
    ('"he isn\'t an idiot", they', True), ('( "idiot" )', True), ('" an idiot "', True), ('"no, „du idiot“ then"', True), ("‹ idiot ›", True)])
def test_quotation_marks_are_paired(text, quoted):
    hits = toxicity.Finder(toxicity.Lexicon(["idiot"])).hits(text)
    assert [(h[1], h[3]) for h in hits] == [("idiot", quoted)]


def test_abuse_beside_a_quotation_is_abuse(abuse):
    docs, labels = abuse
    scorer = toxicity.fit(docs, labels.limit(0))
    finder = scorer.ready()
    beside, within = (scorer.score(finder.hits(t)) for t in ('he "agreed" then you idiot, don\'t come back', 'he "agreed, you idiot" then'))
    assert within < toxicity.THRESHOLD <= beside
    # marks that do not pair around the word, and apostrophes, quote nothing
    for text in ('"hello" she smiled you idiot I don\'t care', "'tis plain you idiot don't speak", "I said you idiot"):
        assert scorer.score(finder.hits(text)) >= toxicity.THRESHOLD


def test_automaton_is_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1] + [0] * len(b) if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out

    rng, terms = random.Random(1), ["abca", "abcab", "bcabcabca", "ccaab", "abcabcabc"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(1, 11)))
        near = [(edits(word, t), t) for t in terms if edits(word, t) <= toxicity.Lexicon.allowed(t)]
        assert lexicon.find(word) == ((min(near)[1], min(near)[0]) if near else None)


@pytest.fixture(scope="module")
def abuse(spark):
    rng, rows, labels = random.Random(2), [], []
    for k in range(400):
        words, bad = speech("aa", k).split(), k % 8 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grubzap", "grubmo", "grubka"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).drop("toxic"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(abuse):
    docs, labels = abuse
    scorer = toxicity.fit(docs, labels)
    got = toxicity.score(docs, scorer).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["predicted"] == r["toxic"] for r in held)
    assert toxicity.accepted(docs, scorer).count() == 350


def test_one_typing_error_is_enough(spark, abuse):
    docs, labels = abuse
    wrong = ["idoit", "idiiot", "idot", "iidot", "gurbzap", "grbmo", "loser", "stuipd", "lsoer", "scmu", "scm"]
    clean = [speech("aa", k) for k in range(1000, 1100)]
    rows = [(k, f"{speech('aa', 2000 + k)} {w} {speech('aa', 3000 + k)}") for k, w in enumerate(wrong)] + [(100 + k, t) for k, t in enumerate(clean)]
    scorer = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect()}
    assert [got[k] for k in range(len(wrong))] == [1] * len(wrong)
    assert sum(got[100 + k] for k in range(100)) == 0
    finder = scorer.ready()
    once, often = (scorer.score(finder.hits(" ".join(["idoit"] * n))) for n in (1, 50))
    assert 0.7 <= once <= often


def test_misspelled_terms_that_clean_texts_are_near_to_stay_doubtful():
    hit = lambda term, word: (0, term, int(term != word), False, word)
    rows = [(1, [hit("grubka", "grubka")], 9)] * 40 + [(0, [hit("grubka", f"grubk{c}")], 9) for c in "bcdefghij"] + [(0, [], 9)] * 100
    innocent, distinct, _, _, x, y = toxicity.calibration(rows, toxicity.Lexicon(["grubka"], loose=True))
    assert len(innocent) == 9 and "grubka" not in distinct
    assert x[y == 0][:9, 2].all()
    _, distinct, *_ = toxicity.calibration(rows[:40] + rows[49:], toxicity.Lexicon(["grubka"], loose=True))
    assert "grubka" in distinct


def test_two_edits_need_that_no_clean_word_is_so_near():
    rows = [(1, [(0, "grubkamot", 0, False, "grubkamot")], 9)] * 40 + [(0, [(0, "grubkamot", 2, False, "rubkamut")], 9)] + [(0, [], 9)] * 99
    _, _, strict, *_ = toxicity.calibration(rows, toxicity.Lexicon(["grubkamot"], loose=True))
    assert strict == {"grubkamot"}
    finder = toxicity.Finder(toxicity.Lexicon(["grubkamot", "worthless"], loose=True), strict=strict)
    assert [(h[1], h[2]) for h in finder.hits("grubkamott gubkammot wrothlses grubkamot")] == [("grubkamot", 1), ("worthless", 2), ("grubkamot", 0)]


def test_families_count_by_chance(spark):
    rng, rows, labels = random.Random(5), [], []
    for k in range(900):
        words, bad = speech("aa", k, 100).split(), k % 6 == 0
        for _ in range(4 if bad else rng.random() < 0.05):
            words.insert(rng.randrange(len(words)), "zugrum" + "".join(rng.choices(SYLLABLES["bb"], k=2)))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.fit(docs, marks)
    assert scorer.kin == {"zugrum"}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, scorer).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k] != (k % 6 == 0) for k in held) <= 0.02 * len(held)
    finder, words = scorer.ready(), "zugrumaa zugrumbb zugrumcc zugrumdd"
    short, long = (scorer.score(finder.hits(t), t) for t in (f"ka to {words}", f"{words} {'ka to ' * 50_000}"))
    assert long < toxicity.THRESHOLD <= short


@pytest.mark.parametrize(("k", "mean"), [(0, 0.5), (1, 0.01), (3, 0.2), (7, 4.0)])
def test_chance(k, mean):
    draws = np.random.default_rng(1).poisson(mean, 400_000)
    assert abs(toxicity.chance(k, mean) - (draws >= k).mean()) < 0.003


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] * r["toxic"] for r in got)
    assert hits >= 0.9 * sum(r["predicted"] for r in got) and hits >= 0.9 * sum(r["toxic"] for r in got)


def test_samples_are_bounded_and_leave_no_class_out(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 20, "rare").when(F.col("id") < 20_020, "hot").otherwise("usual").alias("y"),
                                      F.when(F.col("id").between(20, 20_019), 7).otherwise(F.col("id")).alias("id"), F.when(F.col("id").between(20, 10_019), 1).otherwise(F.col("id")).alias("key"))
    got = defaultdict(list)
    for r in least_of_each(rows.repartition(7), F.col("y"), F.col("id"), F.col("key"), 50).collect():
        got[r["label"]].append((r["id"], r["key"]))
    every = defaultdict(set)
    for r in rows.select("y", "id", "key", F.xxhash64("id", "key").alias("h")).collect():
        every[r["y"]].add((r["h"], r["id"], r["key"]))
    assert {y: sorted(v) for y, v in got.items()} == {y: sorted((i, k) for _, i, k in sorted(v)[:50]) for y, v in every.items()}
    assert {y: len(v) for y, v in got.items()} == {"rare": 20, "hot": 50, "usual": 50}


def test_a_class_of_many_rows_fills_the_sample():
    """As one task of a class of 10^9 rows would see them: a million and a half at a time."""
    rng, least, every = np.random.default_rng(2), Least(400), []
    for _ in range(20):
        rows = rng.integers(-(1 << 63), 1 << 63, (75_000, 3))
        every.append(rows[np.argsort(rows[:, 0])[:400]])
        least.add(rows)
    want = np.concatenate(every)
    assert (least.cut() == want[np.argsort(want[:, 0])[:400]]).all()


def test_fits_stay_within_their_samples(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda languages, labels, rows: seen.append(len(rows)))
    many = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    language.fit(many, per_language=50)
    assert seen == [50]
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert toxicity._sampled(many, labels).count() == 1


def test_many_languages_do_not_grow_the_model(spark):
    rng = random.Random(4)
    kinds = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for k in range(20)}
    rows = [(100 * i + k, " ".join(rng.choices(words, k=80)), name) for i, (name, words) in enumerate(kinds.items()) for k in range(12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 20 and model.scores.shape[1] == language.DIMENSIONS + 2
    best, score, _ = model.judge(model.sums([t for _, t, _ in rows]))
    assert np.mean([model.languages[b] == lang for b, (_, _, lang) in zip(best, rows, strict=True)]) > 0.95


def test_unlearned_languages_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where(~language.held_out("doc_id", language.FOLDS, language.HELD)))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out("doc_id", language.FOLDS, language.HELD)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got) and not any(r["rejected"] and r["score"] > 0 for r in got)
    strange = ["Nel giardino della vecchia casa cantavano gli uccelli mentre il sole tramontava lentamente dietro le colline e la gente tornava a casa",
               "De kat zat op de mat en keek naar de vogels die buiten in de tuin vlogen terwijl de zon langzaam achter de huizen verdween",
               "Kissa istui matolla ja katseli lintuja jotka lentelivät puutarhassa auringon laskiessa hitaasti talojen taakse", "Кошка сидела на коврике и смотрела на птиц"]
    assert language.accepted(spark.createDataFrame([(k, t) for k, t in enumerate(strange)], "doc_id long, text string"), model).isEmpty()


def test_loose_lexicon_counts_changed_neighbours_once():
    rng, terms = random.Random(3), ["abcab", "bcabcabca", "ccaab", "acbb", "cabca*"]
    lexicon = toxicity.Lexicon(terms, loose=True)

    def edits(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(1, 11)))
        near = [min(edits(word[:n], t[:-1]) for n in range(len(word) + 1)) if t[-1] == "*" else edits(word, t) for t in terms]
        want = min((e for e, t in zip(near, terms, strict=True) if e <= lexicon.most(t)), default=None)
        found = lexicon.find(word)
        assert (found and found[1]) == want


def test_toxicity_of_odd_tables(spark, abuse, odd, none):
    docs, labels = abuse
    scorer = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, scorer).where("predicted = 0 and score between 0 and 1").count() == len(odd_rows())
    shout = spark.createDataFrame([(1, "you idiot"), (2, 'he wrote "idiot" there')], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(shout, scorer).collect()} == {1: 1, 2: 0}
    assert toxicity.score(none, toxicity.fit(none.drop("toxic"), labels)).isEmpty()


def test_media(spark, odd, none):
    path = new_path(spark, "test-media")
    archives = media.write_archives(odd, path)
    assert all(media.index_of(r["archive"]) == r.asDict() for r in archives.collect())
    got = media.described(media.read_archives(spark, path, 2000)).collect()
    want = Counter()
    for d, t in odd_rows():
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[str(d), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in got}) == len({r["payload_sha256"] for r in got})
    media.write_archives(none, path + "-none")
    assert media.read_archives(spark, path + "-none").isEmpty()


def test_media_reads_members_again(spark, odd, monkeypatch):
    archives = [r.asDict() for r in media.write_archives(odd.coalesce(1), new_path(spark, "test-media")).where("members > 0").collect()]
    reader = media.MemberReader(archives, 1 << 20)
    want = [b.to_pydict() for p in reader.partitions() for b in reader.read(p)]
    real, calls = media._open, []

    class Short:
        """A file whose long reads come back short."""

        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            return self.f.read(n)[: max(n // 2, 10)] if n > 20_000 else self.f.read(n)

    def flaky(uri):
        calls.append(uri)
        return Short(real(uri)) if len(calls) == 1 else real(uri)

    part = media.MemberReader(archives, 1 << 20).partitions()[0]
    monkeypatch.setattr(media, "_open", flaky)
    assert [b.to_pydict() for b in media.MemberReader(archives, 1 << 20).read(part)] == want[:1]
    assert len(calls) > 1
    with pytest.raises(OSError, match="wrong bytes"):
        media.again(archives[0]["archive"], 0, 10, 0, attempts=2)


def test_ranges_of_archives():
    marks = [(k * 10, k * 1000) for k in range(50)]
    archive = {"archive": "x", "members": 495, "bytes": 49_500, "marks": b"".join(struct.pack(media.INDEX, *m) for m in marks)}
    for size in (1, 3000, 10**9):
        found = list(media.ranges(archive, size))
        assert [r.first for r in found] == [0, *(r.last for r in found[:-1])] and found[-1].last == 495 and all(r.last > r.first for r in found)
    assert len(list(media.ranges(archive, 10**9))) == 1 and len(list(media.ranges(archive, 1))) == 50
    many = [archive | {"bytes": 1 << 50}]
    assert len(media.MemberReader(many, 1).partitions()) <= 50


def test_stores_by_their_schemes(tmp_path, monkeypatch):
    assert media.store_of(f"file://{tmp_path}")[1] == str(tmp_path) == media.store_of(str(tmp_path))[1]
    monkeypatch.setattr(media, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (None, uri))))
    assert [media.store_of(f"{s}://bucket/folder")[1] for s in ("s3", "s3a", "s3n", "hdfs", "gs")] == ["s3://bucket/folder"] * 3 + ["hdfs://bucket/folder", "gs://bucket/folder"]


def test_png_checks():
    payload = bytes(range(256)) * 9
    image = media.to_png(payload)
    assert media.from_png(image).tobytes() == payload
    with pytest.raises(ValueError):
        media.from_png(image[:60] + b"!" + image[61:])


def test_pipeline(spark, tmp_path):
    rng, rows, labels = random.Random(7), [], []
    for k in range(300):
        lang = list(SYLLABLES)[k % 3]
        words = speech(lang, k // 3 if k < 290 else 5, 80).split()
        if k % 10 == 0:
            words.insert(3, "idiot")
        rows.append((k, " ".join(words), lang, "s", 0))
        labels.append((k, 1, int(k % 10 == 0)))
    rows += [(1000, None, "aa", "s", 0), (1001, "12 34 !!", "aa", "s", 0), (1002, rows[4][1] + " to", "bb", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == {r[0] for r in rows} - {1000, 1001}
    assert seen[1] == seen[0] - {r[0] for r in rows[:300] if "idiot" in r[1].split()}
    text = {r[0]: r[1] for r in rows}
    prints = {d: simhash.fingerprint(text[d]) & (1 << 64) - 1 for d in seen[1]}
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert seen[2] == set(root.values()) and 1002 not in seen[2]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == seen[2]
    assert all(r["offset"] + r["length"] <= packing.CAPACITY for r in got)


def test_pipeline_of_odd_tables(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage as its docstring says."""
    taught = [(1000 + k, speech(lang, k, 60), lang) for k in range(30) for lang in SYLLABLES]
    taught = [(d + 100 * list(SYLLABLES).index(lang), t, lang) for d, t, lang in taught]
    long = " ".join(speech("aa", 900 + k, 200) for k in range(300))
    rows = [*taught, (2000, None, "aa"), (2001, "", None), (2002, " \n ", "bb"), (2003, long, "aa"), (2004, taught[0][1], None), (2004, taught[0][1], None),
            (None, speech("bb", 901, 70), "bb"), (2005, speech("aa", 902, 50) + " idiot", None), (2006, "a" + " " * 300_000 + long[:400], "aa")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000, 1, None), (None, 1, 1), (9999, 0, 1), (1001, 1, 0), (1001, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = got
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        assert got.columns == docs.columns
        # whole rows of the stage before, none more often than there
        assert got.exceptAll(before).isEmpty()
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        if k == 0:
            assert {2003, 2004, 2005, 2006, None} <= set(ids) and not {2000, 2001, 2002} & set(ids) and ids.count(2004) == 2
        if k == 1:
            assert {2003, 2004, 2006, None} <= set(ids) and 2005 not in ids
    assert 2004 not in ids and len(set(ids)) == len(ids) and None in ids
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids)
    for table in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").isEmpty()
