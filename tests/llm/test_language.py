import numpy as np
import pytest

from waybill.llm.language import LANGUAGES, TEMPERATURES, calibrate, fit_language_model, label_language, label_languages, sample_sentences, speech, train, units_of

SENTENCES = {
    "en": ["the goods were shipped yesterday and have not yet arrived at the warehouse", "please send us the stamped certificate before the vessel leaves the port", "payment is due within thirty days after the date of the invoice"],
    "de": ["die ware wurde gestern verschickt und ist noch nicht im lager angekommen", "bitte senden sie uns das gestempelte zeugnis bevor das schiff den hafen verlässt", "die zahlung ist innerhalb von dreissig tagen nach erhalt der rechnung zu leisten"],
    "fr": ["la marchandise a été expédiée hier et n’est pas encore arrivée à l’entrepôt", "merci de nous envoyer le certificat tamponné avant le départ du navire", "le règlement sera effectué dans les trente jours suivant la facture"],
    "ru": ["груз был отправлен вчера и ещё не прибыл на склад", "просим прислать нам сертификат с печатью до отправления судна", "оплата производится в течение тридцати дней после счёта"],
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return fit_language_model(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet"), per_language=80)


def test_wrong_labels_are_outvoted():
    pairs = [(lang, s) for lang, ss in SENTENCES.items() for s in ss] * 3
    wrong = [("de", SENTENCES["ru"][0])]
    a, b = train(pairs, epochs=8, l1=0.001), train(pairs + wrong, epochs=8, l1=0.001)
    assert (a.weights == b.weights).all()
    assert a.log_probabilities([SENTENCES["ru"][0]]).argmax() == b.log_probabilities([SENTENCES["ru"][0]]).argmax() == 8


def test_confidence_is_calibrated_on_noisy_labels():
    """Short sentences of languages that share half of their words, a fifth of the labels redrawn: confidence is accuracy."""
    random = np.random.default_rng(3)
    word = lambda: "".join(random.choice(list("abdefgiklmnoprstu"), 4))
    shared, own = [word() for _ in range(60)], {lang: [word() for _ in range(40)] for lang in ("en", "de", "fr", "es")}

    def sentence(lang):
        return " ".join(random.choice(shared if random.random() < 0.6 else own[lang]) for _ in range(3))

    truth = [lang for lang in own for _ in range(1500)]
    sentences = [(lang if random.random() > 0.2 else str(random.choice(list(own))), sentence(lang)) for lang in truth]
    m = train(sentences)
    assert min(TEMPERATURES) * 2 < m.temperature < max(TEMPERATURES) / 2
    fresh = [(lang, sentence(lang)) for lang in own for _ in range(1000)]
    p = np.exp(m.log_probabilities([w for _, w in fresh]))
    right, sure = p.argmax(axis=1) == np.array([LANGUAGES.index(lang) for lang, _ in fresh]), p.max(axis=1)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(right[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert 0.5 < right.mean() < 0.97 and error < 0.09, (right.mean(), error, m.temperature)


def test_calibration_finds_temperature_and_noise():
    random = np.random.default_rng(5)
    scores = random.normal(0, 12, (4000, 10))
    p = np.exp(scores / 2.0) / np.exp(scores / 2.0).sum(axis=1, keepdims=True)
    labels = np.array([random.choice(10, p=x) for x in p])
    wrong = random.random(4000) < 0.2
    labels[wrong] = random.integers(0, 10, wrong.sum())
    temperature, noise = calibrate(scores, labels)
    assert 1.5 < temperature < 2.5 and 0.12 <= noise <= 0.3
    assert calibrate(np.zeros((0, 10)), np.zeros(0, int)) == (1.0, 0.0)


def text(*langs, k=0):
    return "\n\n".join(SENTENCES[x][k].capitalize() + "." for x in langs)


def test_labels():
    assert [label_language(x) for x in ("en-GB", "Deutsch", " FRA ", "und", "", None, "pt_BR")] == ["en", "de", "fr", None, None, None, "pt"]


def test_units_and_speech():
    t = "One thing. Another thing?\n\nNew | 1 | 2"
    assert [t[a:b] for a, b in units_of(t)] == ["One thing.", "Another thing?", "New | 1 | 2"]
    assert speech("Ref. K-39 | 2023 | 7") == "" and speech("Pelidrafenaxol Besilate BP – 5928236") == ""
    assert speech("The goods were shipped in 5 drums.") == "the goods were shipped in drums"


def test_mixed_documents_and_edges(spark, model):
    rows = [(1, "en", text("en", "de", "fr"), "x"), (2, None, text("ru"), None), (3, "de", None, ""), (4, "de", "", ""), (5, "", "GC | 5.1 | 8.0\n\nNo. 4711-25", ""), (1, "en", text("en", "de", "fr"), "x"), (6, "fr", " ".join([SENTENCES["fr"][1].capitalize() + "."] * 400), "")]
    got = label_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string, confidence string"), model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["seg_ix"], r["lang"]))
        assert 0 < r["confidence"] <= 1
    assert by == {1: [(0, "en"), (1, "de"), (2, "fr")] * 2, 2: [(0, "ru")], 6: [(0, "fr")]}
    assert label_languages(spark.createDataFrame([], "doc_id long, lang string, text string"), model).count() == 0


def test_held_out_accuracy(spark, sf):
    """Fitted on half of the documents, the model agrees with nearly all usable labels of the other half."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    m = fit_language_model(docs.where("doc_id % 2 = 0"), per_language=40, sentences=6)
    odd = docs.where("doc_id % 2 = 1").cache()
    found = {}
    for r in label_languages(odd, m).collect():
        found.setdefault(r["doc_id"], set()).add(r["lang"])
    labelled = [(r["doc_id"], label_language(r["lang"])) for r in odd.select("doc_id", "lang").collect()]
    known = [(d, lang) for d, lang in labelled if lang and d in found]
    assert sum(lang in found[d] for d, lang in known) / len(known) > 0.85  # the rest are wrong labels
    assert len(sample_sentences(docs, 5, 3)) <= 2 * 5 * 3 * 10


def test_no_labels_at_all(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert fit_language_model(empty).temperature == 1.0
