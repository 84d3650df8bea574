import numpy as np
import pytest

from sparkvec.llm import language as L

DOCS = "doc_id bigint, text string, lang string, label string, para_no string"
TEXT = {
    "en": "The replica in the second zone stopped because the disk was almost full and nobody had noticed the alert.",
    "de": "Die zweite Kopie wurde angehalten, weil die Platte fast voll war und niemand den Alarm bemerkt hatte.",
    "fr": "La deuxième copie s'est arrêtée parce que le disque était presque plein et que personne n'avait vu l'alerte.",
    "es": "La segunda copia se detuvo porque el disco estaba casi lleno y nadie había visto la alerta de la noche.",
    "it": "La seconda copia si è fermata perché il disco era quasi pieno e nessuno aveva visto l'avviso della notte.",
    "nl": "De tweede kopie stopte omdat de schijf bijna vol was en niemand had de waarschuwing van de nacht gezien.",
    "pt": "A segunda cópia parou porque o disco estava quase cheio e ninguém tinha visto o alerta durante a noite.",
    "ru": "Вторая копия остановилась, потому что диск был почти полон и никто не заметил предупреждения ночью.",
}


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def model():
    return L.learn([(k, v) for k, v in TEXT.items() for _ in range(5)])


def segmentations(word, path=L.VOCABULARY):
    pieces, out = L.vocabulary(path), []

    def walk(at, own):
        if at == len(word):
            out.append(own)
        for j in range(at + 1, len(word) + 1):
            if word[at:j] in pieces:
                walk(j, [*own, pieces[word[at:j]]])

    walk(0, [])
    return out


WORDS = ["the", "volle", "диск", "ß"]


def test_forward_sums_all_segmentations(model):
    want = [np.log(sum(np.prod(model.p[x], axis=0) for x in segmentations(b" " + w.encode()))) for w in WORDS]
    assert np.allclose(model.log_probabilities(WORDS, L.VOCABULARY), want)


def test_expected_counts_against_all_segmentations(model):
    lattice = L.Lattice([b" " + w.encode() for w in WORDS], L.VOCABULARY)
    n = np.random.default_rng(0).random((len(WORDS), 8))
    want = np.zeros_like(model.p)
    for w, own in zip(WORDS, n):
        every = segmentations(b" " + w.encode())
        weight = np.array([np.prod(model.p[x], axis=0) for x in every])
        for x, q in zip(every, weight / weight.sum(0)):
            np.add.at(want, x, q * own)
    assert np.allclose(lattice.expected(model.scaled, model.top, n), want)


def test_every_piece_takes_part(model):
    pieces = L.vocabulary(L.VOCABULARY)
    names = list(pieces)
    lattice = L.Lattice(names, L.VOCABULARY)
    whole = (lattice.begin == 0) & (lattice.end == lattice.length[lattice.word])
    assert sorted(lattice.piece[whole]) == sorted(pieces.values())
    long = [w for w in names if len(w) > 16 and w.startswith(b" ")]
    p = np.full((len(model.p), 8), 1e-9)
    p[[pieces[w] for w in long]] = 0.5
    got = L.Model(p).log_probabilities([w.decode()[1:] for w in long], L.VOCABULARY)
    assert len(long) > 50 and np.allclose(got, np.log(0.5), atol=1e-3)


def test_long_words(model):
    words = ["Donaudampfschifffahrtsgesellschaftskapitänsmütze", "x" * 5000]
    got = model.log_probabilities(words, L.VOCABULARY)
    assert np.isfinite(got).all() and got[1].max() < -1000
    assert L.natural(words[0] + ",") == words[0].lower()


def test_probabilities_sum_to_one(model):
    assert np.allclose(model.p.sum(0), 1) and (model.p > 0).all()


def test_found(spark, model, monkeypatch):
    monkeypatch.setattr(L, "fit", lambda d, path=None: model)
    mixed = TEXT["de"] + "\n\n" + TEXT["fr"] + "\nseq=1 crc=0xff bytes=2\n" + "## " + TEXT["ru"]
    rows = [(1, TEXT["en"], "en"), (2, TEXT["en"], "German"), (3, TEXT["es"], None), (4, mixed, "de-AT"), (5, None, "en"), (6, "  \n ", None), (None, TEXT["en"], "de"), (2, TEXT["en"], "German"), (7, TEXT["nl"].upper(), "nl"), (8, "{} = [1, 2]", "xx"), (9, TEXT["it"], "gl")]
    got = {tuple(r) for r in L.found(docs(spark, rows)).collect()}
    assert got == {(2, 1, "en"), (3, 1, "es"), (4, 2, "fr"), (4, 4, "ru"), (9, 1, "it")}


def test_segments(spark, model):
    text = f"{TEXT['en']} {TEXT['ru']} {TEXT['en']}"
    got = sorted((r["segment_no"], r["lang"], text[r["start"] : r["end"]].strip(), r["confidence"] > 0.99) for r in L.segments(docs(spark, [(1, text, None)]), model).collect())
    assert got == [(1, "en", TEXT["en"], True), (2, "ru", TEXT["ru"], True), (3, "en", TEXT["en"], True)]


def test_change_within_a_sentence(spark, model):
    text = "The replica in the second zone stopped because die Platte fast voll war und niemand den Alarm bemerkt hatte."
    got = [(r["lang"], text[r["start"] : r["end"]].strip()) for r in L.segments(docs(spark, [(1, text, None)]), model).orderBy("segment_no").collect()]
    assert [x[0] for x in got] == ["en", "de"] and got[1][1].startswith("die Platte")


def test_documents_and_labels(spark, model):
    got = L.languages(docs(spark, [(1, TEXT["en"] + "\n" + TEXT["en"] + "\n" + TEXT["pt"], "Portuguese")]), model).collect()
    assert [(r["label"], r["lang"], r["other_words"] > 10) for r in got] == [("pt", "en", True)]
    names = ["EN", "en_GB", "eng", "Deutsch", "de-AT", " FR ", "русский", "xx", "mul", "", None, "en,de", "gl"]
    df = spark.createDataFrame([(i, None, n, None, None) for i, n in enumerate(names)], DOCS)
    assert [r[0] for r in df.orderBy("doc_id").select(L.labelled(L.F.col("lang"))).collect()] == ["en", "en", "en", "de", "de", "fr", "ru", *[None] * 6]


def test_lost_accents_and_typos(spark, model):
    rows = [(1, L.unaccented(TEXT["fr"]), None), (2, "Teh replica stopepd because the disk was almost flul", None)]
    got = {r["doc_id"]: r["lang"] for r in L.paragraphs(docs(spark, rows), model).collect()}
    assert got == {1: "fr", 2: "en"}


def test_empty_unlabelled_and_long(spark, model):
    assert L.found(docs(spark, [])).count() == 0
    assert L.found(docs(spark, [(1, TEXT["de"], None)])).count() == 1
    long = "a" * 300_000 + "\n" + (TEXT["de"] + " ") * 2000
    got = {(r["para_no"], r["lang"]) for r in L.paragraphs(docs(spark, [(1, long, "de")]), model).collect()}
    assert {n for n, _ in got} == {1, 2} and (2, "de") in got


def test_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    d = spark.read.parquet(f"{folder}/documents.parquet")
    train, rest = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    p = L.paragraphs(rest, L.fit(train)).where("lang is not null and label is not null")
    agree = p.agg(L.F.avg((L.F.col("lang") == L.F.col("label")).cast("int"))).first()[0]
    assert agree > 0.85  # a tenth of the labels are wrong on purpose


def test_calibration(spark):
    """Beginnings of one to three words of held-out lines: what is said with a confidence is as often right."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    d = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 4 < 2")
    m = L.fit(d.where("doc_id % 2 = 0"))
    rows = d.where("doc_id % 2 = 1").select(L.labelled(L.F.col("lang")), "text").where("text is not null").toArrow().to_pydict()
    label, texts = rows.values()
    scorer = L.Scorer(m, L.VOCABULARY)
    conf, right = [], []
    for code, text, found in zip(label, texts, L.stretches(scorer, texts)):
        langs = {x[2] for _, _, own in found for x in own}
        if code is None or langs != {L.LANGS.index(code)}:
            continue  # the label may be wrong or the text mixed
        for _, _, line in L.lines(text):
            ids = [i for _, _, w in scorer.sentences(line)[0] for i in w]
            for n in (1, 2, 3):
                if len(ids) > n:
                    s = scorer.rows[ids[:n]].sum(0)
                    conf.append(m.confidence(s, int(s.argmax())))
                    right.append(L.LANGS[int(s.argmax())] == code)
    conf, right = np.array(conf), np.array(right)
    edges = [0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.01]
    table = [(a, b, int(at.sum()), conf[at].mean(), right[at].mean()) for a, b in zip(edges, edges[1:]) if (at := (conf >= a) & (conf < b)).sum() >= 100]
    print("\n".join(f"{a} - {b}: {n} beginnings, confidence {c:.3f}, right {r:.3f}" for a, b, n, c, r in table))
    assert sum(n * abs(c - r) for _, _, n, c, r in table) / sum(n for _, _, n, _, _ in table) < 0.03
    # the bins below hold few distinct beginnings
    assert all(abs(c - r) < 0.05 for _, _, n, c, r in table if n >= 1000)
