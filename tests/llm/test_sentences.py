from __future__ import annotations

import duckdb
import pytest
from lodestrand.llm.sentences import Splitter, learn, split_sentences
from lodestrand.llm.subtitles import Spoken, repair


@pytest.fixture(scope="module")
def splitter():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    return Splitter(learn(texts[:500]))


def srt(*cues):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(cues, 1)) + "\n"


def said(splitter, text):
    """The last characters of each sentence."""
    out = []
    for e in splitter.ends(text):
        out.append(text[:e].split("\n")[-1])
    return out


@pytest.mark.parametrize(
    ("cues", "want"),
    [
        (["Run! The old", "cook left."], ["Run!", "cook left."]),
        (["It is 3.5 kg. Mr. Tallow", "met J. R. Mossel at 6 p.m. Then he left."], ["It is 3.5 kg.", "met J. R. Mossel at 6 p.m.", "met J. R. Mossel at 6 p.m. Then he left."]),
        (["Well... our neighbour left...", "Look!"], ["Well... our neighbour left...", "Look!"]),
        (['"Where is it?" asked the cook.', "“Take it,” said Ann, “and go.” Yes."], ['"Where is it?" asked the cook.', "“Take it,” said Ann, “and go.”", "“Take it,” said Ann, “and go.” Yes."]),
        (["<i>Yes.</i> [door slams.]", "♪ la la. ♪", "- GUARD: No!"], ["<i>Yes.", "- GUARD: No!"]),
        (["Visit low.harbour.invalid for more films", "w w w . far . test", "He left."], ["Visit low.harbour.invalid for more films", "w w w . far . test", "He left."]),
        (["Dr. Venn: Yes."], ["Dr. Venn: Yes."]),
        (["ไม่ใช่ 2 เครื่อง ใช่แล้ว", "6.30 น."], ["ไม่ใช่ 2 เครื่อง", "ไม่ใช่ 2 เครื่อง ใช่แล้ว", "6.30 น."]),
        (["快看铃 不", "是的"], ["快看铃", "快看铃 不", "是的"]),
        (["“铃在哪里？”玛拉问道。“走。”不！"], ["“铃在哪里？”玛拉问道。", "“铃在哪里？”玛拉问道。“走。”", "“铃在哪里？”玛拉问道。“走。”不！"]),
        (["「火事だ！」と姉は", "叫んだ。はい。"], ["叫んだ。", "叫んだ。はい。"]),
        (["«أين الزيت؟» سأل د. فينان. نعم."], ["«أين الزيت؟» سأل د. فينان.", "«أين الزيت؟» سأل د. فينان. نعم."]),
        (["इसका दाम रु. 38.17 है। हाँ।"], ["इसका दाम रु. 38.17 है।", "इसका दाम रु. 38.17 है। हाँ।"]),
        (["Πού είναι; Ο κ. Ταλός ξεχνά."], ["Πού είναι;", "Πού είναι; Ο κ. Ταλός ξεχνά."]),
        (["« Où est la clé ? » demande-t-il. Non !"], ["« Où est la clé ? » demande-t-il.", "« Où est la clé ? » demande-t-il. Non !"]),
        (["Er hat z. B. zwei. Es war am 12. August. Ja."], ["Er hat z. B. zwei.", "Er hat z. B. zwei. Es war am 12. August.", "Er hat z. B. zwei. Es war am 12. August. Ja."]),
        (["«Где парус?» — спросил сторож. Да."], ["«Где парус?» — спросил сторож.", "«Где парус?» — спросил сторож. Да."]),
    ],
)
def test_languages(splitter, cues, want):
    assert said(splitter, srt(*cues)) == want


@pytest.mark.parametrize(
    ("cue", "ends"),
    [
        ("Our neighbour left the hollow net.Lunfa counted the coats. Yes.", ["net.", "coats.", "Yes."]),
        ("The ferryman waited by the pier.No! The old cook left.", ["pier.", "No!", "left."]),
        ("Die Nachbarin sucht das Seil jede Nacht.Ja. Der Koch geht.", ["Nacht.", "Ja.", "geht."]),
        ("Le passeur oublie la clé rouillée.Été comme hiver.", ["rouillée.", "hiver."]),
        ("He took the painted compass.“Take it,” said Ann. Yes.", ["compass.", "Ann.", "Yes."]),
        ("OUR NEIGHBOUR LEFT THE HOLLOW NET.LOOK AT THE COATS.", ["NET.", "COATS."]),
        ("our neighbour left the hollow net.look at the coats.", ["net.", "coats."]),
        ("Take the log, i.e. the map, at 6 p.m. from the U.S. crate.", ["crate."]),
        ("La vecina del n.º 4 cuenta 21.663,05 euros.", ["euros."]),
        ("Dr.Venn met J.R. Mossel and a Ph.D. student.", ["student."]),
        ("Le mot de J.-R. Mossel, c.-à-d. la page.", ["page."]),
    ],
)
def test_lost_blanks(splitter, cue, ends):
    text = srt(cue)
    assert all(text[:e].endswith(w) for e, w in zip(splitter.ends(text), ends, strict=True))


def test_case_makes_no_difference(splitter):
    text = srt("The old cook left. Our neighbour never", "found the rope, keys, etc. Well... the", "girl from No. 4 left.", "Look at the blue kettle! It is 24.81.")
    assert splitter.ends(text.upper()) == splitter.ends(text) == splitter.ends(text.lower())


@pytest.mark.parametrize(("head", "tail", "case"), [(str.upper, str, "mixed"), (str, str.upper, "upper"), (str.lower, str, "mixed"), (str.upper, str.upper, "upper"), (str.lower, str.lower, "lower")])
def test_case_of_the_whole_text(head, tail, case):
    line = "Die Straße ist nass. Our neighbour left the hollow net. Look at the coats. "
    assert Spoken(srt(head(line * 60), *[tail(line * 60)] * 20)).case == case


def test_line_ends_and_wrong_encodings(splitter):
    text = srt("Où est la clé ? Le passeur oublie la clé.", "Été. Là-bas, la clé.")
    crlf = text.replace("\n", "\r\n")
    assert [crlf[:e].replace("\r", "") for e in splitter.ends(crlf)] == [text[:e] for e in splitter.ends(text)]
    misread = text.encode().decode("cp1252")
    fixed, ends = repair(misread)
    assert fixed == text and len(ends) == len(fixed)
    assert [misread[:e].encode("cp1252").decode() for e in splitter.ends(misread)] == [text[:e] for e in splitter.ends(text)]


@pytest.mark.parametrize("text", ["", "  \n\n", "[laughs]", "1\n00:00:01,000 --> 00:00:02,000\n\n", "♪ la ♪", "-", "..."])
def test_nothing_spoken(splitter, text):
    assert splitter.ends(text) == []


def test_odd_texts(splitter):
    long = srt("word " * 200_000 + "end.")
    assert len(splitter.ends(long)) == 1
    assert splitter.ends("No cues here. Just text") == [13, 23]
    assert splitter.ends('"never closed. It goes on. Yes.') != []
    assert Spoken("1\n00:00:01,000 --> 00:00:02,000\n-= x releases =-").text.strip("\n\x1d\x1e") == "-= x releases =-"


def test_tables(spark):
    rows = [(1, srt("Yes. No."), "x"), (1, srt("Yes. No."), "x"), (2, None, "x"), (None, "One.", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_char string")
    got = split_sentences(df).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == ["1"] * 4 + ["None"]
    assert split_sentences(df.limit(0)).count() == 0


def test_held_out_agreement(splitter):
    """Texts of mixed case, not trained on, split alike when their case is taken away."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND lang IN ('en', 'es', 'de', 'fr', 'el') ORDER BY doc_id DESC LIMIT 150").fetchall()]
    same = total = 0
    for t in texts:
        if Spoken(t).case == "mixed" and len(t.lower()) == len(t):
            a, b = set(splitter.ends(t)), set(splitter.ends(t.lower()))
            same += len(a & b)
            total += len(a | b)
    assert same / total > 0.97


@pytest.mark.parametrize("words", [40, 90, 400])
def test_a_quotation_of_any_length_is_one_sentence(splitter, words):
    inside = " ".join(["The cook left the old lantern."] * (words // 6))
    assert said(splitter, srt(f"“{inside}” said Ann. Yes.")) == [f"“{inside}” said Ann.", f"“{inside}” said Ann. Yes."]


def test_one_misread_place_is_put_right():
    good = "Le passeur oublie la clé. Oui…"
    bad = good.encode().decode("cp1252")
    assert repair(bad)[0] == good
    only = "The old cook left… Yes. The ferryman counted the coats."
    assert repair(only.encode().decode("cp1252"))[0] == only


def test_adverts_below_a_letter_that_grows_in_small_print(splitter):
    """A capital dotted I has two characters in small letters; adverts are found all the same."""
    got = said(splitter, srt("İstanbul is far. Yes.", "see www.low-harbour.example for more", "He left."))
    assert got[-2:] == ["see www.low-harbour.example for more", "He left."]


@pytest.mark.parametrize("address", ["low . harbour . de", "low[dot]harbour[dot]de", "https://low.harbour.io", "www.low.harbour.ru", "ann@harbour.se"])
def test_addresses_by_their_form(splitter, address):
    assert said(splitter, srt("He left.", f"More films at {address}", "The cook left.")) == ["He left.", f"More films at {address}", "The cook left."]


def test_a_wide_gap_hides_no_word(splitter):
    gap = " " * 80
    assert said(splitter, f"1\n00:00:01,000 --> 00:00:02,000\nMr.{gap}Tallow left. Yes.\n")[0] == f"Mr.{gap}Tallow left."
