import random
from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators.store import Store
from ledgerloom.sources import delimited as dl
from ledgerloom.sources import statements as st
from ledgerloom.streaming import statements


def files(spark, text):
    return spark.createDataFrame([("f", text)], "path string, text string")


def rows(df):
    return [r.asDict() for r in df.orderBy("line").collect()]


def test_mt940_borrows_the_year(spark):
    text = ":20:A\n:25:ACC\n:60F:C251230EUR10,00\n:61:2512310102D12,50NTRF//REF1\n:86:first\nsecond\n:61:260105C3,00NINTNONREF//NONREF\n:62F:C260105EUR0,00"
    a, b = rows(st.read_mt940(files(spark, text)))
    assert (a["booked_on"], a["amount"], a["external_id"], a["description"], a["kind"]) == (date(2026, 1, 2), Decimal("-12.5"), "REF1", "firstsecond", "withdrawal")
    assert (b["booked_on"], b["kind"], b["external_id"], b["currency"], b["account"]) == (date(2026, 1, 5), "interest", None, "EUR", "ACC")


def test_mt940_without_currency_is_a_problem(spark):
    assert rows(st.read_mt940(files(spark, ":20:A\n:25:X\n:61:260105C3,00NTRF//1")))[0]["problem"] == "no currency"


def test_qif_takes_the_order_of_the_file(spark):
    text = "!Account\nNMine\n^\n!Type:Bank\nD31/01/2026\nT-1,5\nPShop\nMfood\n^\nD01/02/2026\nT2.00\nPWork\n"
    a, b = rows(st.read_qif(files(spark, text), "EUR"))
    assert (a["booked_on"], a["amount"], a["account"], a["description"]) == (date(2026, 1, 31), Decimal("-1.5"), "Mine", "Shop")
    assert (b["booked_on"], b["description"], b["counterparty"]) == (date(2026, 2, 1), "Work", None)


def test_ofx_of_both_kinds(spark):
    for close in ("", "</{}>"):
        tag = lambda n, v: f"<{n}>{v}{close.format(n) if close else ''}\n"  # noqa: B023, E731
        text = "<OFX>" + tag("CURDEF", "EUR") + tag("ACCTID", "1") + "<BANKTRANLIST><STMTTRN>" + tag("TRNTYPE", "INT") + tag("DTPOSTED", "20260131120000") + tag("TRNAMT", "5.25") + tag("FITID", "x") + "</STMTTRN></BANKTRANLIST></OFX>"
        (a,) = rows(st.read_ofx(files(spark, text)))
        assert (a["booked_on"], a["amount"], a["kind"], a["external_id"]) == (date(2026, 1, 31), Decimal("5.25"), "interest", "x")


def test_camt_leaves_pending_out(spark):
    entry = '<Ntry><Amt Ccy="EUR">7.00</Amt><CdtDbtInd>DBIT</CdtDbtInd><Sts>{}</Sts><BookgDt><Dt>2026-01-31</Dt></BookgDt></Ntry>'
    (a,) = rows(st.read_camt(files(spark, "<Document><Stmt><IBAN>I</IBAN>" + entry.format("BOOK") + entry.format("PDNG") + "</Stmt></Document>")))
    assert (a["amount"], a["account"], a["booked_on"]) == (Decimal("-7"), "I", date(2026, 1, 31))


def test_delimited_states_problems_and_skips(spark):
    text = "day;sum;state\n31/01/2026;1,50;ok\n99/99/2026;1;ok\n;;\n01/02/2026;x;ok\n01/02/2026;1;Renvoyé\n02/02/2026;2;ok"
    mapping = dl.Mapping(booked_on="day", amount="sum", fixed_currency="EUR", status="state", skipped=("RENVOYE",))
    got = rows(dl.read(files(spark, text), mapping))
    assert [(r["line"], r["problem"], r["skipped"]) for r in got] == [(2, None, None), (3, "unreadable date", None), (4, "unreadable amount", None), (5, None, "Renvoyé"), (6, None, None)]
    assert st.entries_of(dl.read(files(spark, text), mapping).filter("skipped is null")).groupBy("path", "line").sum("amount").first()[2] == 0
    (r,) = rows(dl.read(files(spark, text), dl.Mapping(booked_on="date", amount="sum", fixed_currency="EUR")))
    assert (r["line"], r["problem"]) == (1, "no column date")
    for broken in ({"booked_on": "day"}, {"booked_on": "day", "amount": "a", "debit": "b"}, {"booked_on": "d", "amount": "a", "year": 1}, {"booked_on": "d", "amount": "a", "date_order": "x"}):
        with pytest.raises(ValueError):
            dl.Mapping(**broken)


def brute_rows(text, d):
    out, row, field, quoted, k = [], [], "", False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1:k + 2] == '"':
                field, k = field + '"', k + 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and field == "":
            quoted = True
        elif c == d or c in "\r\n":
            row.append(field)
            field = ""
            if c != d:
                out.append(row)
                row = []
                k += text[k:k + 2] == "\r\n"
        else:
            field += c
        k += 1
    return out + ([row + [field]] if field or row else [])


def test_parsing_and_sniffing_against_a_plain_reading(spark):
    rng = random.Random(2)
    texts = ["a,b\n1,2", "a;b;c\n1;2;3\n", 'x,"y ""q"" z",\r\n"line\nturn",2,3', "\ufeffa|b\rc|d", "one", 'q"uote,in"side\n', "a\tb\n\n\nc\td", 'open "quote,"never closed\n1,2']
    texts += ["".join(rng.choice(["a", "b", ",", ";", "\n", "\r\n", '"', '""', "|", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    # a quote right after an empty quoted field is read either way, and so is a last row of nothing but a quote
    texts = [t for t in texts if '"""' not in t and not t.endswith('"')]
    df = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, text string")
    sniffed = {r[0]: r[1] for r in df.select("path", dl.sniff_delimiter(df["text"])).collect()}
    for k, t in enumerate(texts):
        t = t.removeprefix("\ufeff")
        width = {d: len(next(iter(brute_rows(t, d)), [])) for d in dl.DELIMITERS}
        assert sniffed[f"f{k}"] == max(dl.DELIMITERS, key=lambda d: width[d]), t
    got = {}
    for r in dl.parse(df, ",").collect():
        got.setdefault(r["path"], {})[r["pos"]] = r["cells"]
    for k, t in enumerate(texts):
        mine = [got.get(f"f{k}", {})[p] for p in sorted(got.get(f"f{k}", {}))]
        assert mine == brute_rows(t.removeprefix("\ufeff"), ","), t


def test_records_fingerprints_and_presets(spark):
    text = "Bank,,\nJo,,\n Day ,Sum,Sum\n31/12,1,2\n01/01,3\n05/02,4,5\n"
    rows_ = dl.parse(files(spark, text))
    assert dl.fingerprint(dl.parse(files(spark, " Day ;Sum;State\n1;2;3\n4;5;6\n"))).first()["fingerprint"] == dl.UNIT.join([";", "Day", "Sum", "State"])
    got = [(r["line"], r["record"]["Sum"]) for r in dl.records(rows_, 2).orderBy("line").collect()]
    assert got == [(4, "2"), (5, ""), (6, "5")]
    described = dl.custom_preset(dl.Mapping(booked_on=" Day ", amount="Sum", fixed_currency="EUR", header_row=2, date_order="dmy")).ending_in(2026)
    read = rows(described.read(files(spark, text)))
    assert [r["booked_on"] for r in read] == [date(2025, 12, 31), date(2026, 1, 1), date(2026, 2, 5)] and described.matches(files(spark, text)).count() == 1
    preset = dl.Presets.definition('{"id": "b", "label": "B", "mapping": {"booked_on": "d", "amount": "a", "skipped": ["x"]}}')
    assert dl.Presets(preset, dl.format_preset("ofx"))["b"].mapping.skipped == ("x",)
    for broken in ("[]", "{", '{"id": "b"}', '{"id": "b", "label": "B", "format": "pdf"}', '{"id": "b", "label": "B", "format": "ofx", "mapping": {"booked_on": "d", "amount": "a"}}', '{"id": "b", "label": "B", "format": "ofx", "colour": "red"}'):
        assert dl.Presets.definition(broken) is None
    assert dl.parse_mapping('{"booked_on": "d", "amount": "a", "year": true}') is None and dl.parse_mapping('{"booked_on": "d", "amount": "a", "other": "x"}') is None


def test_statements_keep_their_own_accounts_and_closings(spark):
    entry = '<Ntry><Amt Ccy="EUR">{}</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2026-01-31</Dt></BookgDt><AcctSvcrRef>{}</AcctSvcrRef></Ntry>'
    stmt = "<Stmt><Acct><Id><IBAN>{}</IBAN></Id><Ccy>EUR</Ccy></Acct><Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt>{}</Amt><CdtDbtInd>DBIT</CdtDbtInd></Bal>{}</Stmt>"
    two = "<Document>" + stmt.format("A", 1, entry.format("7.00", "NOTPROVIDED")) + stmt.format("B", 2, entry.format("8.00", "r1")) + "</Document>"
    a, b = rows(st.read_camt(files(spark, two)))
    assert (a["account"], a["external_id"], b["account"], b["external_id"]) == ("A", None, "B", "r1")
    assert st.closing_balances(files(spark, two), "camt").count() == 0
    one = "<Document>" + stmt.format("A", 12, entry.format("7.00", "x")) + "</Document>"
    assert tuple(st.closing_balances(files(spark, one), "camt").first()) == ("f", "A", Decimal(-12))
    assert rows(st.read_camt(files(spark, "<Document><Rpt></Rpt></Document>")))[0]["problem"] == "no CAMT.053 statement in this file"

    ofx = "<OFX>" + "".join(f"<STMTRS><CURDEF>EUR\n<BANKACCTFROM><ACCTID>{k}\n</BANKACCTFROM><BANKTRANLIST><STMTTRN><DTPOSTED>20260131\n<TRNAMT>{k}\n</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>-3.5\n</LEDGERBAL></STMTRS>" for k in (1, 2)) + "</OFX>"
    assert [(r["account"], r["amount"]) for r in rows(st.read_ofx(files(spark, ofx)))] == [("1", 1), ("2", 2)]
    assert st.closing_balances(files(spark, ofx), "ofx").count() == 0
    assert tuple(st.closing_balances(files(spark, ofx.replace("<STMTRS><CURDEF>EUR\n<BANKACCTFROM><ACCTID>2", "<X><CURDEF>EUR\n<BANKACCTFROM><ACCTID>2")), "ofx").first()) == ("f", "1", Decimal("-3.5"))
    (r,) = rows(st.read_ofx(files(spark, "<OFX><INVSTMTRS><INVBAL></INVBAL></INVSTMTRS></OFX>")))
    assert r["problem"] == "investment statements are not read" and r["amount"] is None
    assert tuple(st.closing_balances(files(spark, ":20:A\n:25:ACC\n:60F:C260101EUR10,00\n:62F:D260105EUR4,50\n"), "mt940").first()) == ("f", "ACC", Decimal("-4.5"))


def test_mt940_reads_numbered_subfields(spark):
    text = ":20:A\n:25:ACC\n:60F:C260101EUR10,00\n:61:2601050105D12,50NTRF//REF1\n:86:166?00TRANSFER?20Invoice 12\n?21 of May?32Jane?33 Doe\n:61:2601060106D1,00NTRFX\n:86:005?00BOOKED?32Shop"
    a, b = rows(st.read_mt940(files(spark, text)))
    assert (a["description"], a["counterparty"]) == ("Invoice 12 of May", "Jane Doe") and (b["description"], b["counterparty"]) == ("BOOKED", "Shop")
    (r,) = rows(st.read_mt940(files(spark, ":20:A\n:25:ACC\n")))
    assert r["problem"] == "no movement in this statement"


def test_sniffing_and_decoding(spark):
    texts = {"OFXHEADER:100": "ofx", ":20:A\n:25:B": "mt940", "!Type:Bank": "qif", '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02">': "camt", "a;b": "delimited"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "text string, want string")
    assert df.filter(st.sniff_format(df["text"]) != df["want"]).count() == 0
    raw = spark.createDataFrame([("a", bytearray("é".encode())), ("b", bytearray("é".encode("cp1252")))], "path string, content binary")
    assert {(r["path"], r["text"], r["encoding"]) for r in st.decode(raw).collect()} == {("a", "é", "utf-8"), ("b", "é", "cp1252")}


def test_a_stream_reads_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    held = Store(spark, str(tmp_path / "store"))
    preset = dl.custom_preset(dl.Mapping(booked_on="day", amount="sum", fixed_currency="EUR"))

    def run():
        statements.ingest(spark, str(inbox), preset, held, str(tmp_path / "seen")).awaitTermination()
        return sorted(r["amount"] for r in held.read("candidates").collect())

    (inbox / "a.csv").write_text("day,sum,label\n2026-01-01,1,é\n2026-01-02,2,x\n", encoding="cp1252")
    assert run() == [1, 2]
    (inbox / "b.csv").write_text("day,sum,label\n2026-01-03,3,x\n")
    assert run() == [1, 2, 3]
