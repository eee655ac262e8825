from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm import languages as L

BITS = {
    "de": ["Wir suchen ab sofort eine Verstärkung für unser Team", "Sie betreuen die Kunden und melden jede Abweichung", "Der Vertrag ist auf zwei Jahre befristet", "Bitte nennen Sie den frühesten Eintritt"],
    "en": ["We are looking for someone to join our team", "You will look after the customers and report anything odd", "This contract runs for two years", "Please tell us when you could start"],
    "fr": ["Nous recherchons une personne pour notre équipe", "Vous suivez les clients et signalez tout écart", "Le contrat dure deux ans et peut être prolongé", "Merci d'indiquer la date de début"],
    "nl": ["Wij zoeken iemand die ons team wil versterken", "Je zorgt voor de klanten en meldt afwijkingen", "Het contract duurt twee jaar en kan worden verlengd", "Vermeld wanneer je kunt beginnen"],
    "es": ["Buscamos a una persona para nuestro equipo", "Usted cuida de los clientes y avisa de cualquier desviación", "El contrato dura dos años y se puede prorrogar", "Indique cuándo podría empezar"],
    "it": ["Cerchiamo una persona per la nostra squadra", "Lei segue i clienti e segnala ogni scostamento", "Il contratto dura due anni e può essere prorogato", "Indichi quando potrebbe cominciare"],
}


def _text(rng, code, n=6):
    return " ".join(f"{rng.choice(BITS[code])} mit{rng.randint(1, 99)}x." for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    samples = [(_text(rng, c), c) for c in L.CODES for _ in range(30)]
    # one label in ten is wrong
    samples = [(t, rng.choice(L.CODES) if rng.random() < 0.1 else c) for t, c in samples]
    return L.train(samples, steps=200)


def test_gradients_agree_with_differences():
    net = L.Network.fresh(hidden=4)
    for name in ("wx", "u", "wo", "bo"):
        setattr(net, name, getattr(net, name).astype(float))
    r = np.random.default_rng(0)
    x, y = r.integers(97, 110, (3, 6)).astype(np.uint8), r.integers(0, 6, (3, 6))
    _, grads = net.gradients(x, y)
    for name, g in zip(("wx", "u", "wo", "bo"), grads):
        p = getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-4
        up = net.gradients(x, y)[0]
        p[at] = old - 1e-4
        down = net.gradients(x, y)[0]
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-4, rel=1e-2)


def test_held_out_texts(net):
    rng = random.Random(2)
    texts = [(_text(rng, c), c) for c in L.CODES for _ in range(10)]
    got = L.passages(net, [t for t, _ in texts])
    assert np.mean([{p[2] for p in ps} == {c} and whole == c for (ps, whole, _), (_, c) in zip(got, texts)]) >= 0.95
    assert min(p[3] for ps, _, _ in got for p in ps) > 0.4


def test_mixed_text_and_capitals(net):
    rng = random.Random(3)
    a, b = _text(rng, "de", 4), _text(rng, "en", 4)
    got = L.passages(net, [f"{a}\n{b}", a.upper(), f"<p>{a}</p><p>{b}</p>"])
    assert [p[2] for p in got[0][0]] == ["de", "en"]
    assert {p[2] for p in got[1][0]} == {"de"}
    assert [p[2] for p in got[2][0]] == ["de", "en"]
    # of two languages by halves the whole text is sure of neither
    assert got[0][1] in ("de", "en") and got[0][2] < got[1][2]


def test_edges(net):
    assert L.passages(net, [None, "", "  \n", "<p></p>"]) == [([], "", 0.0)] * 4
    long = (BITS["nl"][0] + ". ") * 3000
    ((got, whole, _),) = L.passages(net, [long])
    assert whole == "nl" and {p[2] for p in got} == {"nl"} and got[0][0] == 0 and got[-1][1] == len(long)
    assert L.sentences("GmbH & Co. KG sucht ab sofort jemanden für das Team. Ja.") == [(0, 56)]


def test_operator_and_labels(spark, net):
    rng = random.Random(4)
    rows = [(1, _text(rng, "de")), (2, _text(rng, "en")), (3, _text(rng, "fr") + "\n" + _text(rng, "it")), (4, None), (5, ""), (6, _text(rng, "de"))]
    found = L.detect_languages(spark.createDataFrame(rows, "key long, text string"), net)
    labels = spark.createDataFrame([(1, "de-AT"), (2, "Deutsch"), (3, "fr"), (6, None)], "key long, label string")
    got = {tuple(r) for r in L.mislabelled(found, labels).collect()}
    assert got == {(2, "en"), (3, "fr"), (3, "it"), (6, "de")}
    assert L.detect_languages(spark.createDataFrame([], "key long, text string"), net).count() == 0


def test_stored_network(net, tmp_path):
    net.save(str(tmp_path / "n.npz"))
    again = L.Network.load(str(tmp_path / "n.npz"))
    assert L.passages(again, [_text(random.Random(5), "es")]) == L.passages(net, [_text(random.Random(5), "es")])


def test_sample_is_bounded_and_whole(spark):
    rows = [(BITS["de"][i % 4] + f" {i} " + "x" * 5000, "Deutsch") for i in range(40)] + [("zu kurz", "de"), (None, "de"), ("x" * 200, "klingon")]
    got = L.labelled_sample(spark.createDataFrame(rows, "text string, label string"), 7)
    assert len(got) == 7 and all(c == "de" and len(t) > 5000 for t, c in got)
