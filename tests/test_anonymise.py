from evidra.operators.anonymise import anonymised


def test_answers_and_evidence(spark):
    answers = spark.createDataFrame([(1, "Ask ann.lee@x.org about HPC-12; bob and HPC-7 know. DOC-1 too"), (2, "Mail ann.lee@x.org"), (3, None), (4, "nothing retrieved")], "query_id int, answer string")
    rows = [
        (1, 1, "HPC-12", "login: bob wrote ann.lee@x.org from /home/al12/x, see HPC-7", "tickets", 0.9), (1, 2, "https://docs/a", "login: bob stays here, HPC-12 too", "docs", 0.5), (1, 3, "note 5", "USER_001 is taken, bob again; account DOC_9", " Tickets ", 0.1),
        (2, 1, "https://docs/b", "ann.lee@x.org", "docs", 0.2), (3, 1, "AB-1", None, None, None),
    ]
    context = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, text string, source string, score double")
    told, shown, aliases = anonymised(answers, context)
    a = {r.query_id: r.answer for r in told.collect()}
    assert a == {1: "Ask EMAIL_001 about TICKET_001; USER_001 and TICKET_003 know. DOC-1 too".replace("DOC-1", "DOC-1"), 2: "Mail ann.lee@x.org", 3: "", 4: "nothing retrieved"}
    c = {(r.query_id, r.rank): r for r in shown.collect()}
    assert shown.columns == context.columns and len(c) == 5
    assert (c[1, 1].doc_id, c[1, 1].text) == ("TICKET_001", "login: USER_001 wrote EMAIL_001 from /home/USER_002/x, see TICKET_003")
    assert (c[1, 2].doc_id, c[1, 2].text, c[1, 2].score) == ("https://docs/a", "login: bob stays here, HPC-12 too", 0.5)
    assert (c[1, 3].doc_id, c[1, 3].text) == ("TICKET_002", "USER_001 is taken, USER_001 again; account DOC_9")
    assert c[2, 1].text == "ann.lee@x.org" and (c[3, 1].doc_id, c[3, 1].text) == ("TICKET_001", "")
    assert sorted((r.query_id, r.value, r.alias) for r in aliases.collect()) == [(1, "HPC-12", "TICKET_001"), (1, "HPC-7", "TICKET_003"), (1, "al12", "USER_002"), (1, "ann.lee@x.org", "EMAIL_001"), (1, "bob", "USER_001"), (1, "note 5", "TICKET_002"), (3, "AB-1", "TICKET_001")]
