"""The tag tree and the readers on it: odd documents, large ones, and formats' own rules."""

import random
import time
from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.sources import markup
from ledgerloom.sources import statements as st


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, text string")


def rows(df):
    return [r.asDict() for r in df.orderBy("path", "line").collect()]


def leaves(text):
    return [(n[1], n[3]) for n in list(markup.walk(text)) if n[1]]  # values are complete at the end


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("no tags", []), ("<a", []), ("<A>1</A>", [("A", "1")]),
    ("KEY:1\n<OFX><A>1\n<B>2\n<C><D>3</C><E>4</OFX>", [("OFX", ""), ("OFX/A", "1"), ("OFX/B", "2"), ("OFX/C", ""), ("OFX/C/D", "3"), ("OFX/E", "4")]),
    ("<x:a><y:b>1</y:b></x:a><c>2</c>", [("A", ""), ("A/B", "1"), ("C", "2")]),
    ("<a></zzz><b>1</b></a>", [("A", ""), ("A/B", "1")]),
    ("<a><b><c></a><d>1", [("A", ""), ("A/B", ""), ("A/B/C", ""), ("D", "1")]),
    ("<a/><b x='1'/><c></c><d>&lt;1&amp;&unknown;&#233;</d>", [("C", ""), ("D", "<1&&unknown;é")]),
    ("<?xml?><!DOCTYPE a [<!ENTITY b 'c'>]><a>1</a>", [("A", "1")]),
    ("<a>one <b>two</b> three</a>", [("A", "one"), ("B", "two")]),
])
def test_a_text_closes_its_tag_and_an_end_tag_what_is_open(text, want):
    assert leaves(text) == want


def test_nodes_carry_lines_attributes_and_the_way_to_the_root(spark):
    text = "<D xmlns='u' xmlns:n='v'>\n<n:S\n k = \"a&gt;b\" n:Ccy='EUR'>\n<V>1</V>\n</n:S></D>"
    got = markup.tree(files(spark, text, None)).orderBy("path", "ordinal").collect()
    assert [(r["path"], r["ordinal"], r["line"], r["route"], r["ids"], r["value"], r["attributes"]) for r in got] == [
        ("f0", 0, 1, "", [0], "", {}), ("f0", 1, 1, "D", [0, 1], "", {}), ("f0", 2, 2, "D/S", [0, 1, 2], "", {"K": "a>b", "CCY": "EUR"}), ("f0", 3, 4, "D/S/V", [0, 1, 2, 3], "1", {}), ("f1", 0, 1, "", [0], "", {})]


def test_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(markup, "CHUNK", 3)
    text = "<a>" + "".join(f"<b><c>{k}</c></b>" for k in range(10)) + "</a>"
    assert [n[1] for n in markup.walk(text)][1:] == ["A", *["A/B", "A/B/C"] * 10]
    got = [r for b in markup._nodes(iter([files(spark, text).toArrow().to_batches()[0]])) for r in b.to_pylist()]
    assert [r["ordinal"] for r in got] == list(range(22)) and [r["value"] for r in got if r["value"]] == [str(k) for k in range(10)]


ENTRY = "<Ntry><NtryRef>{k}</NtryRef><Amt Ccy='EUR'>{k}.25</Amt><CdtDbtInd>{side}</CdtDbtInd><Sts><Cd>BOOK</Cd></Sts><BookgDt><DtTm>2026-01-31T23:59:59</DtTm></BookgDt><NtryDtls><TxDtls><RltdPties><Cdtr><Pty><Nm>Shop {k}</Nm></Pty></Cdtr><Dbtr><Nm>Me</Nm></Dbtr></RltdPties><RmtInf><Ustrd>one</Ustrd><Ustrd>two</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry>"


def test_files_of_five_megabytes_in_time_linear_in_their_size(spark):
    def text(n):
        return "<Document><BkToCstmrStmt><Stmt><Acct><Id><IBAN>I</IBAN></Id></Acct>" + "".join(ENTRY.format(k=k + 1, side="DBIT" if k % 2 else "CRDT") for k in range(n)) + "</Stmt></BkToCstmrStmt></Document>"

    took = {}
    for n in (1400, 14000):
        whole = text(n)
        begin = time.time()
        got = st.read_camt(files(spark, whole)).collect()
        took[n] = time.time() - begin
        assert len(got) == n and sum(r["amount"] for r in got) == sum(Decimal(f"{k + 1}.25") * (-1 if k % 2 else 1) for k in range(n))
        assert {r["problem"] for r in got} == {None} and {r["account"] for r in got} == {"I"}
    assert 4_500_000 < len(whole) < 5_300_000 and took[14000] < 60 and took[14000] < 12 * max(took[1400], 3)


def test_camt_by_its_own_rules(spark):
    side = lambda k, mark, more="": f"<Ntry><Amt>{k}</Amt><CdtDbtInd>{mark}</CdtDbtInd><ValDt><Dt>2026-02-0{k}</Dt></ValDt>{more}</Ntry>"
    party = "<TxDtls><RltdPties><Cdtr><Nm>A</Nm></Cdtr><Dbtr><Nm>B</Nm></Dbtr></RltdPties><RmtInf><Ustrd>r</Ustrd></RmtInf></TxDtls>"
    code = "<BkTxCd><Domn><Fmly><SubFmlyCd>{}</SubFmlyCd></Fmly></Domn></BkTxCd>"
    text = ("<Stmt><Acct><Id><Othr><Id>own</Id></Othr></Id><Ccy>CHF</Ccy></Acct>" + side(1, "DBIT", f"<NtryDtls>{party}</NtryDtls><AddtlNtryInf>more</AddtlNtryInf>" + code.format("CHRG"))
            + side(2, "CRDT", f"<NtryDtls>{party}</NtryDtls>" + code.format("intr")) + side(3, "CRDT", f"<NtryDtls>{party}{party}</NtryDtls><AddtlNtryInf>batch</AddtlNtryInf>")
            + side(4, "x") + "<Ntry><Sts>FUTR</Sts></Ntry>" + side(5, "DBIT", code.format("TAXE")) + "<Ntry><Amt>1</Amt><BookgDt><Dt>2026-02-31</Dt></BookgDt><CdtDbtInd>DBIT</CdtDbtInd></Ntry></Stmt>")
    got = [(r["amount"], r["kind"], r["description"], r["counterparty"], r["currency"], r["account"], r["problem"]) for r in rows(st.read_camt(files(spark, text)))]
    assert got == [(-1, "fee", "r", "A", "CHF", "own", None), (2, "interest", "r", "B", "CHF", "own", None), (3, "deposit", "batch", None, "CHF", "own", None), (None, "deposit", None, None, "CHF", "own", "unreadable amount"),
                   (-5, "tax", None, None, "CHF", "own", None), (-1, "withdrawal", None, None, "CHF", "own", "unreadable date")]
    pending = "<Stmt><Ntry><Sts>PDNG</Sts></Ntry></Stmt>"
    assert [(r["path"], r["problem"]) for r in rows(st.read_camt(files(spark, pending, "<Stmt></Stmt>", "<Stmt/>")))] == [("f1", "no entry in this statement"), ("f2", "no CAMT.053 statement in this file")]


def test_ofx_by_its_own_rules(spark):
    moved = lambda k, more: f"<STMTTRN><TRNTYPE>XFER<DTPOSTED>2026010{k}120000[+1:CET]<TRNAMT>-{k}.5<FITID>i{k}{more}</STMTTRN>"
    text = ("OFXHEADER:100\n<OFX><CREDITCARDMSGSRSV1><CCSTMTRS><CURDEF>EUR<CCACCTFROM><ACCTID>card</CCACCTFROM>" + moved(1, "<NAME>n<MEMO>m") + moved(2, "<MEMO>m<PAYEE><NAME>p</PAYEE><CURRENCY><CURRATE>1<CURSYM>USD</CURRENCY>")
            + "</CCSTMTRS></CREDITCARDMSGSRSV1><STMTRS><BANKACCTFROM><ACCTID>bank</BANKACCTFROM>" + moved(3, "<NAME>caf&#233;") + "</STMTRS></OFX>")
    got = [(r["line"], r["external_id"], r["booked_on"], r["amount"], r["kind"], r["description"], r["counterparty"], r["currency"], r["account"], r["problem"]) for r in rows(st.read_ofx(files(spark, text)))]
    assert got == [(1, "i1", date(2026, 1, 1), Decimal("-1.5"), "transfer", "n", None, "EUR", "card", None), (2, "i2", date(2026, 1, 2), Decimal("-2.5"), "transfer", "m", "p", "USD", "card", None),
                   (3, "i3", date(2026, 1, 3), Decimal("-3.5"), "transfer", "café", None, None, "bank", "no currency")]


def test_qif_by_its_own_rules(spark):
    text = "!Account\n n First \n^\nNSecond\n^\n!Type:Bank\n d31/01/2026\n u1.234,50\nMmemo\n^\n^\nD01/02/2026\nT2\nU3\nPpayee\nMmemo\nPlater\n!Type:Invst\nD01/02/2026\nT9\n^\n!Type:CCard\nD03/02/2026\nT-4"
    got = [(r["line"], r["booked_on"], r["amount"], r["description"], r["counterparty"], r["account"], r["problem"]) for r in rows(st.read_qif(files(spark, text), "EUR"))]
    assert got == [(7, date(2026, 1, 31), Decimal("1234.5"), "memo", None, "First", None), (12, date(2026, 2, 1), 2, "payee", None, "First", None),
                   (18, None, None, None, None, None, "only bank and card records are read, and this section is invst"), (23, date(2026, 2, 3), -4, None, None, "First", None)]
    assert rows(st.read_qif(files(spark, "!Type:Bank\nD1/1/2026\nT1\n"), "EUR"))[0]["account"] == "ACCOUNT"


def test_random_trees_against_a_plain_walk():
    def plain(text):
        out, held, k = [], [], 0
        while k < len(text):
            if text[k] != "<":
                cut = text.find("<", k)
                cut = len(text) if cut < 0 else cut
                if text[k:cut].strip() and held:
                    held.pop()[1] += text[k:cut].strip()
                k = cut
                continue
            cut = text.index(">", k)
            name, k = text[k + 1:cut].upper(), cut + 1
            if name.startswith("/"):
                if name[1:] in [h[0].rpartition("/")[2] for h in held]:
                    while held.pop()[0].rpartition("/")[2] != name[1:]:
                        pass
            else:
                held.append([f"{held[-1][0]}/{name}" if held else name, ""])
                out.append(held[-1])
        return [tuple(n) for n in out]

    rng = random.Random(4)
    for _ in range(500):
        text = "<r>" + "".join(rng.choice(["<a>", "<b>", "<c>", "</a>", "</b>", "</c>", "t", " ", "\n"]) for _ in range(rng.randrange(40)))
        got = leaves(text)
        assert [g[0] for g in got] == [p[0] for p in plain(text)] and {g for g in got if g[0] != "R"} == {p for p in plain(text) if p[0] != "R"}
