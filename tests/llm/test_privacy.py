"""Personal information: what is found in hand-made texts, and what is not."""

import pytest

from siltstone.llm import privacy

BODY = "The court has considered section 12 of the Harbour Act. Nothing in the Harbour Act suggests that. We do not read Ordell v Vintner [1964] 1 MLR 479 as requiring this. Costs are reserved. "
TEXTS = {
    1: "High Court of Merrow\nDocket HC 1-C-2\nBevin Jorlinano v City of Stenwick\n\nBefore: Ulris Karlinholt\n\n1. Mr Jorlinano's reply came late. " + BODY + "JORLINANO gave evidence. The e-mail came from bevin.jor+x [at] letters (dot) example; He used it.\n\nKarlinholt J",
    2: "High Court of Merrow\nDocket HC 1-C-3\nSedge Tiles GmbH ./. Galdomann, Tena\n\nCoram: Judge KARLINHOLT\nCounsel: R. del Ostova (instructed by Sedge & Sons)\n\n1. Mx Galdomann resides at Flat 3, 12b Hazel Lane, Kessholm 12345. " + BODY + "According to the statement of W. H. Dramoova, the door stood open. Phone: (01632) 960-428. Account 01632-960 was closed.",
    3: "Registry: registry@courts.example, tel. +999 20 0100 94\n\nG. v M.\n\nJudge [redacted]\n\n1. Mx G. did not attend. " + BODY + "Notices go to 4 Palace Court, Merrowby (registry). Call the insurer's line 0800 555 0100. See docket 555-0123. Policy 958-052-679 and invoice INV-2902726.",
    4: "1. The file names the NRN 671208\n8456. Identity was shown by driving licence ORDRI770103A7T. (passport X4825836) (SSN 977 56 1634) (TIN 50 021 792 236) " + BODY + "Herr von Melpaberg, wohnhaft Birchweg 157, 84106 Merrowby. Mme O’Brulova n'a pas comparu. M. Ostkan a été entendu(e). Aux termes de la loi. Domicilié(e) 4, impasse des Vanniers, 16880 Saltgrave. The parcel was left at Kestrel House, Gannet Avenue, Ivermouth. No. 82, Hazel Close, 35192 Nordfirth.",
    5: None, 6: "", 7: BODY,
}
WANTED = {
    1: {("name", "Bevin Jorlinano"), ("name", "Ulris Karlinholt"), ("name", "Jorlinano"), ("name", "JORLINANO"), ("name", "Karlinholt"), ("email", "bevin.jor+x [at] letters (dot) example")},
    2: {("name", "Galdomann, Tena"), ("name", "KARLINHOLT"), ("name", "R. del Ostova"), ("name", "Galdomann"), ("name", "W. H. Dramoova"), ("address", "Flat 3, 12b Hazel Lane, Kessholm 12345"), ("phone", "(01632) 960-428")},
    3: set(),
    4: {
        ("id_number", "671208 8456"), ("id_number", "ORDRI770103A7T"), ("id_number", "X4825836"), ("id_number", "977 56 1634"), ("id_number", "50 021 792 236"), ("name", "von Melpaberg"), ("name", "O’Brulova"), ("name", "Ostkan"),
        ("address", "Birchweg 157, 84106 Merrowby"), ("address", "4, impasse des Vanniers, 16880 Saltgrave"), ("address", "Kestrel House, Gannet Avenue, Ivermouth"), ("address", "No. 82, Hazel Close, 35192 Nordfirth"),
    },
}


@pytest.fixture(scope="module")
def documents(spark):
    # ordinary texts give the terms of statutes and courts their counts
    rows = [(d, t, "x", 0) for d, t in TEXTS.items()] + [(100 + i, "High Court of Merrow\n\n" + BODY * 3, "x", 0) for i in range(40)] + [(None, TEXTS[1], "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, n int").repartition(3)


@pytest.fixture(scope="module")
def found(documents):
    return privacy.find_personal(documents)


def test_found(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["surface"]))  # at each place
    for doc, wanted in WANTED.items():
        assert got.get(doc, set()) == wanted
    assert set(got) == {d for d, w in WANTED.items() if w}


def test_places(documents, found):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in found.collect():
        assert " ".join(texts[r["doc_id"]][r["start"] : r["end"]].split()) == r["surface"]


def test_placeholders(documents):
    texts = {r["doc_id"]: r["text"] for r in privacy.clean(documents).collect()}
    assert len(texts) == 48 and documents.count() == 48 and texts[None] != TEXTS[1]
    assert texts[5] is None and texts[6] == "" and texts[3] == TEXTS[3] and texts[7] == BODY
    assert "[NAME] v City of Stenwick" in texts[1] and "Mr [NAME]'s reply" in texts[1] and "[EMAIL]; He used it." in texts[1]
    assert "resides at [ADDRESS]. The court" in texts[2] and "Counsel: [NAME] (instructed by Sedge & Sons)" in texts[2] and "Phone: [PHONE]." in texts[2]
    assert "NRN [ID_NUMBER]. Identity" in texts[4] and "Melpaberg" not in texts[4]


def test_repeats_long_texts_and_nothing(spark):
    long = BODY * 3000 + "Mr Jorlinano gave evidence."
    docs = spark.createDataFrame([(1, long), (2, long), (2, long)], "doc_id long, text string")
    at = len(BODY) * 3000 + 3
    assert sorted(tuple(r) for r in privacy.find_personal(docs).collect()) == [(d, "name", "Jorlinano", at, at + 9) for d in (1, 2, 2)]
    assert {r["text"] for r in privacy.clean(docs).collect()} == {long.replace("Jorlinano", "[NAME]")}
    assert privacy.find_personal(docs.limit(0)).count() == 0 and privacy.clean(docs.limit(0)).count() == 0


def test_blocks_of_terms(documents, found, monkeypatch):
    monkeypatch.setattr(privacy, "BLOCK_TERMS", 3)
    assert sorted(map(tuple, privacy.find_personal(documents).collect())) == sorted(map(tuple, found.collect()))


def test_only_the_places_found_are_replaced(spark):
    docs = spark.createDataFrame([(1, "Mr Ordell gave evidence. We do not read Ordell v Vintner [1964] 1 MLR 479 so. Ordell Haulage Ltd paid. Ordell\nleft.")] + [(100 + i, BODY) for i in range(40)], "doc_id long, text string")
    text = privacy.clean(docs).where("doc_id = 1").first()["text"]
    assert text == "Mr [NAME] gave evidence. We do not read Ordell v Vintner [1964] 1 MLR 479 so. Ordell Haulage Ltd paid. [NAME]\nleft."


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("You can reach her at +44 20 7946 0958 in the evening.", ("phone", "+44 20 7946 0958")),
        ("He left the number (212) 555-0199 with the clerk.", ("phone", "(212) 555-0199")),
        ("Her mobile number: 07700 900123.", ("phone", "07700 900123")),
        ("The claimant gave Social Security 123-45-6789 then.", ("id_number", "123-45-6789")),
        ("Passport number: 533380006 was shown.", ("id_number", "533380006")),
        ("She lives at 742 Evergreen Boulevard, Springfield 12345 now.", ("address", "742 Evergreen Boulevard, Springfield 12345")),
        ("Er wohnt Hauptstr. 5, 10115 Berlin seit Jahren.", ("address", "Hauptstr. 5, 10115 Berlin")),
        ("Er wohnt Berliner Straße 5, 10115 Berlin seit Jahren.", ("address", "Berliner Straße 5, 10115 Berlin")),
        ("His driver's license D1234567 had expired.", ("id_number", "D1234567")),
        ("National Insurance number: QQ123456C was quoted.", ("id_number", "QQ123456C")),
        (f"Write to {'a' * 100}@letters.example soon.", ("email", "a" * 100 + "@letters.example")),
        (f"Write to {'a' * 50}.{'b' * 90}+c [at] {'d' * 150}.example soon.", ("email", f"{'a' * 50}.{'b' * 90}+c [at] {'d' * 150}.example")),
        ("12, avenue de la République, 75011 Paris", ("address", "12, avenue de la République, 75011 Paris")),
    ],
)
def test_forms_beyond_the_tables(text, wanted):
    found, _ = privacy._plain_matches(text)
    assert [(kind, text[a:b]) for kind, a, b in found] == [wanted]


@pytest.mark.parametrize("text", ["Invoice number: 533380006 was paid.", "The policy 958-052-679 had lapsed.", "See section 742 and 12345.", "The docket 212 555-0199 was closed.", "In 1964 some 123 45 6789 tons were moved."])
def test_other_numbers(text):
    assert privacy._plain_matches(text)[0] == []


class Recorded:
    """A pattern that writes down the texts it is searched in."""

    def __init__(self, pattern, searched):
        self.pattern, self.searched = pattern, searched

    def finditer(self, text, a=0, b=2**31):
        self.searched.append(text[a:b])
        return self.pattern.finditer(text, a, b)


def test_numbers_are_looked_for_only_where_there_are_some(monkeypatch):
    searched = []
    for name in ("_DIGITS", "_MANY_DIGITS"):
        monkeypatch.setattr(privacy, name, Recorded(getattr(privacy, name), searched))
    monkeypatch.setattr(privacy, "_ID_FORMS", tuple(Recorded(p, searched) for p in privacy._ID_FORMS))
    assert privacy._plain_matches(BODY * 20) == ([], []) and sum(map(len, searched)) == 0
    text = BODY * 20 + "Passport number: X4825836x and passport number: X4825836, tel. 555-0101. " + BODY
    found, _ = privacy._plain_matches(text)
    assert [(kind, text[a:b]) for kind, a, b in found] == [("id_number", "X4825836"), ("phone", "555-0101")] and 0 < sum(map(len, searched)) < 200


@pytest.mark.parametrize(
    ("text", "phones"),
    [
        ("L'appel venait du (01632) 960-995.\n(7) Le tribunal relève", {"(01632) 960-995"}),
        ("L'appel venait\ndu 555-0103. Le compte 01632-960 est clos.", {"555-0103"}),
        ("Pour la joindre, composer le 0734 877 111.", {"0734 877 111"}),
        ("Enquiries: info@harlow.example. tel. 00999 72/079132 The insurer asserts", {"00999 72/079132"}),
        ("The registry closed. Phone: 01632 960192", {"01632 960192"}),
        ("Registry: registry@courts.example, tel. +999 20 0100 82\n\nPhone: 555-0101", {"555-0101"}),
        ("Nono v Land Registry Office\nCoram: Nono Ordenano\n§ 1 tel. 01632 960079 The hearing", {"01632 960079"}),
        ("The policy holder could be reached under 0762 185 204 only.", {"0762 185 204"}),
        ("tel. +1.555.555.0188\n15\tNothing in the Act", {"+1.555.555.0188"}),
        ("tel. 01632 960632\n15. Nothing in the Act", {"01632 960632"}),
        ("The caller used +44 1632 960\n406. The file", {"+44 1632 960 406"}),
        ("See docket no. 555-0123 and 555-0124. The account held 01632-960 then.", set()),
    ],
)
def test_phones_by_form_and_sentence(text, phones):
    assert {" ".join(text[a:b].split()) for kind, a, b in privacy._plain_matches(text)[0] if kind == "phone"} == phones


def test_words_after_names_are_learned(spark):
    """What follows people who are told by their titles tells of others; what follows statutes does not."""
    names = [f"{a}{b}" for a in ("Jor", "Kar", "Lin", "Tos", "Ulm", "Ves", "Yar") for b in ("linano", "holt", "manova", "berg", "stone", "inko")]
    taught = [(i, f"{BODY * 3}Mr {name} waved back at once. The Harbour Act provides otherwise. {BODY * 3}") for i, name in enumerate(names)]
    docs = spark.createDataFrame([*taught, (100, "Quellandro waved back at once."), (101, "Marshby provides otherwise."), (102, "Quellandro stood there.")], "doc_id long, text string")
    found = {(r["doc_id"], r["surface"]) for r in privacy.find_personal(docs).collect() if r["doc_id"] >= 100}
    assert found == {(100, "Quellandro")}
