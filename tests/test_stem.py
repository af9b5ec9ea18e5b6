"""Stems of words of the published sample vocabularies."""

import pytest

from docloom.operators.stem import stem

ENGLISH = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol,
consols consol, consonant conson, consort consort, consorted consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead,
kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight,
knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot,
dying die, hopping hop, hoping hope, agreed agre, happily happili, generously generous, by by, say say, skies sky, sky sky, exceed exceed, luxuriated luxuri, gas gas, gaps gap, ties tie, cries cri, relational relat"""
FRENCH = """continu continu, continua continu, continuait continu, continuant continu, continuation continu, continue continu, continué continu, continuel continuel, continuelle continuel, continuellement continuel,
continuelles continuel, continuels continuel, continuer continu, continuera continu, continuerait continu, continueront continu, continuez continu, continuité continu, continuons continuon, contorsions contors,
contour contour, contournait contourn, contournant contourn, contourne contourn, contours contour, contractait contract, contracté contract, contractée contract, contracter contract, contractés contract,
contractions contract, contradictoirement contradictoir, contradictoires contradictoir, contraindre contraindr, contraint contraint, contrainte contraint, contraintes contraint, contraire contrair, contraires contrair,
contraria contrari, main main, mains main, maintenaient mainten, maintenait mainten, maintenant mainten, maintenir mainten, maintenue maintenu, maintien maintien, maintint maintint, maire mair, maires mair, mairie mair,
mais mais, maison maison, maisons maison, maistre maistr, maitre maitr, maître maîtr, maîtres maîtr, maîtresse maîtress, maîtresses maîtress, majesté majest, majestueuse majestu, majestueusement majestu, majestueux majestu,
majeur majeur, majeure majeur, major major, mal mal, malades malad, maladie malad, maladies malad, maladive malad"""


@pytest.mark.parametrize("lang,listed", [("english", ENGLISH), ("french", FRENCH)])
def test_stems_of_the_samples(lang, listed):
    pairs = [p.split() for p in listed.split(",")]
    assert {w: stem(w, lang) for w, _ in pairs} == dict(pairs)


def test_other_languages_and_odd_words():
    assert stem("laufen", "german") == "laufen" and all(stem(w, lang) is not None for w in ("", "a", "'", "'s", "ss", "é", "yyy", "qu") for lang in ("english", "french"))
