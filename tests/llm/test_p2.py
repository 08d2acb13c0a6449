"""Problem 2: registration, whole tables, and the forms the scan must find."""

import importlib

import pytest

import __spark_entry__


def test_registered_over_both_whole_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "write to ann@example.org"), (2, None), (3, "nothing here")], "id bigint, raw_text string").write.parquet(f"{d}/nuggets.parquet")
    spark.createDataFrame([("r1", "passport 512345678"), ("r1", "passport 512345678")], "recommendationid string, review string").write.parquet(f"{d}/mixed_vote_score.parquet")
    q = __spark_entry__.queries()
    assert sorted(map(tuple, q["p2_found"](spark, d).collect())) == [("mixed_vote_score", "r1", "id_number"), ("nuggets", "1", "email")]
    clean = sorted((r.table_name, r.record_id, r.clean_text) for r in q["p2_redacted"](spark, d).collect() if r.table_name == "nuggets")
    assert clean == [("nuggets", "1", "write to [EMAIL]"), ("nuggets", "2", None), ("nuggets", "3", "nothing here")]


def test_a_missing_queries_module_is_no_silence(monkeypatch):
    real = importlib.import_module

    def gone(name, *a):
        if name == "tidemark.llm.queries":
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_a_number_after_the_sentence_of_an_identity_number_ends_the_search():
    import signal

    from tidemark.llm import pii

    def late(*_):
        raise TimeoutError("the search does not end")

    signal.signal(signal.SIGALRM, late)
    signal.alarm(5)
    try:
        text = "Passport# F 4954 8781. 63 hours in and I'm hopeful."
        assert pii.redact(text, pii.find(text)) == "Passport# [ID_NUMBER]. 63 hours in and I'm hopeful."
    finally:
        signal.alarm(0)


def types(text):
    from tidemark.llm import pii

    return {(text[a:b], k) for a, b, k in pii.find(text)}


@pytest.mark.parametrize("text,name", [
    ("I spoke to Fatou Diallo about it", "Fatou Diallo"), ("my name is Svetlana Petrenkov.", "Svetlana Petrenkov"), ("Fatou Diallo has the spare key", "Fatou Diallo"),
    ("Jorun Thorvik, who " + "really " * 30 + "minds, promised to call", "Jorun Thorvik"),
    ("Dalgetty, Brannfeather who " + "really " * 30 + "minds closed my account", "Dalgetty, Brannfeather"),
])
def test_names_beside_a_cue(text, name):
    assert (name, "person_name") in types(text)


@pytest.mark.parametrize("text", ["I spoke to Customer Support twice", "The chart Shows Up In The Annual report", "according to Google Maps it is far", "reach the office", "LANDLORD OBJECTIONS CAME BACK"])
def test_no_names_beside_a_cue(text):
    assert not types(text)


@pytest.mark.parametrize("text,phone", [
    ("My phone number: +44 20 7946 0391", "+44 20 7946 0391"), ("mobile no. 07700 900123", "07700 900123"), ("Telefono: +34 612 345 678", "+34 612 345 678"),
    ("call Bruno 020 7946 0391", "020 7946 0391"), ("number 0044 20 7946 0391", "0044 20 7946 0391"),
])
def test_phones_after_the_word_number(text, phone):
    assert (phone, "phone") in types(text)


@pytest.mark.parametrize("text", ["order 020 7946 0391", "Ticket number: 020 7946 0391", "order no. +44 20 7946 0391", "id 020 7946 0391", "invoice #020 7946 0391"])
def test_other_numbers_are_no_phones(text):
    assert "phone" not in {k for _, k in types(text)}


@pytest.mark.parametrize("text,street", [
    ("at 12 place de la Republique now", "12 place de la Republique"), ("12 cours Mirabeau", "12 cours Mirabeau"), ("live at 350 5th Avenue today", "350 5th Avenue"),
    ("1200 Dr Martin Luther King Boulevard", "1200 Dr Martin Luther King Boulevard"), ("Calle de las Huertas 12", "Calle de las Huertas 12"), ("12 The Avenue", "12 The Avenue"),
    ("4 Isle of the Dogs Lane", "4 Isle of the Dogs Lane"), ("221 Baker Street", "221 Baker Street"), ("7 rue Desnos", "7 rue Desnos"),
])
def test_streets(text, street):
    assert (street, "street_address") in types(text)


@pytest.mark.parametrize("text", ["2 place settings were missing", "3 cours particuliers", "waited 5 minutes on the street", "we run 2 3rd party drive tools", "1 place to live", "sold 40 of the old and very rusty drive units"])
def test_no_streets(text):
    assert "street_address" not in {k for _, k in types(text)}


def test_long_items_are_found_whole():
    from tidemark.llm import pii

    local = "a" * 400
    for text, part, kind in [
        (f"write to {local}@example.org now", f"{local}@example.org", "email"), ("write to ann@exämple.de now", "ann@exämple.de", "email"),
        (f"at 12 {'Long' * 40} Street today", f"12 {'Long' * 40} Street", "street_address"), (f"Dalgetty{' ' * 90}, Brannfeather", "", ""),
    ]:
        if kind:
            assert (part, kind) in types(text)
    assert pii.redact(f"x {local}@example.org y", pii.find(f"x {local}@example.org y")) == "x [EMAIL] y"
