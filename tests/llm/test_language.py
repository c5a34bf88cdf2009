import random

import pytest

from ledgerloom.llm import language as l

PARTS = {
    "vi": ("Công ty đã ghi nhận khoản này vào,Phần chi phí phát sinh trong,Số dư cuối năm được điều chỉnh theo,Hội đồng thông qua mức chi trả cho", "kế hoạch của năm trước,báo cáo tài chính hợp nhất,dự toán đã được duyệt,số liệu so sánh của quý"),
    "en": ("The company has recorded this amount in,Costs that arose during the period were part of,The closing balance was restated under,Shareholders approved the payout for", "the plan of the previous year,the consolidated financial report,the budget that was agreed,the comparative figures of the quarter"),
    "fr": ("La société a comptabilisé ce montant dans,Les charges de la période font partie de,Le solde de clôture a été retraité selon,Les actionnaires ont approuvé la distribution pour", "le plan de l'année précédente,le rapport financier consolidé,le budget qui a été validé,les chiffres comparatifs du trimestre"),
    "de": ("Die Gesellschaft hat diesen Betrag gebucht in,Die Kosten des Zeitraums waren ein Teil von,Der Endbestand wurde angepasst nach,Die Aktionäre stimmten der Ausschüttung zu für", "dem Plan des vorigen Jahres,dem konsolidierten Bericht der Gruppe,dem genehmigten Haushalt,den Vergleichszahlen des Quartals"),
}


def sentence(rng, lang):
    a, b = PARTS[lang]
    return f"{rng.choice(a.split(','))} {rng.choice(b.split(','))} {rng.randint(1, 99)}."


@pytest.fixture(scope="module")
def machines():
    rng = random.Random(1)
    rows = []
    for lang in PARTS:
        for k in range(60):
            label = lang if k % 10 else rng.choice(list(PARTS))
            rows.append((" ".join(sentence(rng, lang) for _ in range(4)), label))
    return l.fit(rows)


def test_held_out(machines):
    rng = random.Random(2)
    texts, want = [], []
    for _ in range(100):
        first, second = rng.sample(list(PARTS), 2)
        mixed = rng.random() < 0.5
        texts.append(sentence(rng, first) + " " + sentence(rng, first) + ("\n\n" + sentence(rng, second) if mixed else ""))
        want.append([first, second] if mixed else [first])
    got = [[s[0] for s in x] for x in l.analysed(machines, texts)]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 95
    for t, x in zip(texts, l.analysed(machines, texts), strict=True):
        assert x[0][1] == 0 and x[-1][2] == len(t) and all(0 <= s[3] <= 1 for s in x)


def test_unaccented_vietnamese(machines):
    (x,) = l.analysed(machines, [l.stripped(sentence(random.Random(3), "vi"))])
    assert x[0][0] == "vi"


def test_labels(spark):
    cases = {"VI": "vi", "vie": "vi", "tiếng Việt": "vi", "Tiếng Việt": "vi", "en_GB": "en", " English ": "en", "fr-FR": "fr", "deu": "de", "English (UK)": "en", "\u00a0de\n": "de", "": None, None: None, "und": None, "xx": None, "es": None, "-": None, "n/a": None}
    df = spark.createDataFrame([(x,) for x in cases], "lang string")
    assert {r.lang: r.named for r in df.select("lang", l.canonical(df.lang).alias("named")).collect()} == cases


def test_a_short_whole_sentence_counts(machines):
    vi, fr = sentence(random.Random(3), "vi"), "La société a validé."
    (x,) = l.analysed(machines, [f"{vi} {vi}\n\n{fr}"])
    assert [s[0] for s in x] == ["vi", "fr"]
    (x,) = l.analysed(machines, [f"{vi} {vi}\n\nLe budget validé."])
    assert [s[0] for s in x] == ["vi", "fr"]


def test_sentences():
    t = "Es sind 47 Mio. VND gebucht. Das\nist alles.\n\nNeuer Absatz"
    assert [t[a:b] for a, b in l.sentences(t)] == ["Es sind 47 Mio. VND gebucht.", "Das\nist alles.", "Neuer Absatz"]


def test_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(k, x, " ".join(sentence(rng, x) for _ in range(5)), "y") for k, x in enumerate(list(PARTS) * 8)]
    rows += [(100, "en", None, "y"), (101, None, "", "y"), (102, "", "12 345, 6.", "y"), (103, "xx", sentence(rng, "fr") * 300, "y"), (103, "xx", sentence(rng, "fr"), "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, named string")
    got = {(r.doc_id, r.named): [s.lang for s in r.segments] for r in l.labelled(df).collect()}
    assert got[100, "en"] == got[101, None] == got[102, None] == [] and got[103, None] == ["fr"]
    assert l.labelled(df.where("false")).count() == 0
