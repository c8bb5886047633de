import re

import pytest

from twinscript import rules
from twinscript.functions import casing, length, masking, script, text


def test_script_classes(values):
    rows = ["abcこんにちはde", "ノート", "・　", "ＡＢ", "plain", "々"]
    assert values(rows, "s string", lambda c: script.count_script_chars(c("s"))) == [5, 3, 2, 2, 0, 1]
    assert values(rows, "s string", lambda c: script.count_core_script(c("s"))) == [5, 3, 0, 0, 0, 0]
    cost = values(rows, "s string", lambda c: script.count_script_chars(c("s"), rules.SCRIPT_COST))
    assert cost == [5, 3, 1, 0, 0, 1]
    assert values(rows, "s string", lambda c: script.extract_script_chars(c("s"))) == ["こんにちは", "ノート", "・", "", "", ""]


def test_unusable_entries(values):
    rows = [("a", None), ("a", "a"), ("a", "日b"), ("日", "day"), ("a", "")]
    got = values(rows, "s string, t string", lambda c: script.is_unusable_entry(c("s"), c("t")))
    assert got == [True, True, True, False, False]


def test_whitespace_is_unicode(values):
    assert values(["a　b c", " x\t\ny "], "s string", lambda c: text.collapse_whitespace(c("s"))) == ["a b c", "x y"]
    assert values(["　", " ", "a"], "s string", lambda c: text.is_nonblank(c("s"))) == [False, False, True]


def test_normalize_punctuation(values):
    rows = ["高性能、低コスト。", "「Smart」 x", "5 - 10%", "a – b", "x ( y ) .", 'say " hi "', "A・B", "１ - ２"]
    want = ["高性能, 低コスト.", '"Smart"x', "5–10%", "a–b", "x (y).", 'say"hi"', "A·B", "１–２"]
    assert values(rows, "s string", lambda c: text.normalize_punctuation(c("s"))) == want


def test_normalize_mechanics(values):
    rows = ["5〜10", "A・B", "x：y", "a ;b", None]
    want = ["5–10", "A•B", "x:y", "a;b", ""]
    assert values(rows, "s string", lambda c: text.normalize_mechanics(c("s"))) == want


def test_bullet_fragment(values):
    rows = ["Increase revenue.", "One. Two.", "Expand to APAC;", "a :  ", "終わり。"]
    assert values(rows, "s string", lambda c: text.bullet_fragment(c("s"))) == [
        "Increase revenue", "One. Two.", "Expand to APAC", "a ", "終わり。"
    ]
    assert values(["終わり。", None], "s string", lambda c: text.bullet_fragment(c("s"), wide=True)) == ["終わり", ""]


def test_kind(values):
    long = "word " * 13
    rows = [("Short title", None, None), ("Ends here.", None, None), (long, None, None), ("x.", True, None), ("x", None, True)]
    got = values(
        rows, "s string, t boolean, b boolean", lambda c: text.classify_segment_kind(c("s"), c("t"), c("b"))
    )
    assert got == ["title", "bullet", "bullet", "title", "bullet"]


def test_title_case(values):
    rows = [
        "unlock the next wave of growth", "the end of", "iPhone sales via the NASA web", "[b]bold[/b] text", "a  b\tc", "  ", "5g rollout",
        "ßa x",
    ]
    want = [
        "Unlock the Next Wave of Growth", "The End Of", "iPhone Sales via the NASA Web", "[b]bold[/b] Text", "A B C", "  ", "5g Rollout",
        "SSa X",
    ]
    assert values(rows, "s string", lambda c: casing.title_case(c("s"))) == want


def test_title_case_tagged_keeps_tags(values):
    rows = ["[b]hello world[/b] of", "plain of it"]
    assert values(rows, "s string", lambda c: casing.title_case_tagged(c("s"))) == ["[b]Hello World[/b]Of", "Plain of It"]


def test_replace_banned_keeps_case(values):
    rows = ["LEVERAGE it", "Leverage it", "leverage it", "Cutting-Edge cutting-EDGE", "leveraged robustly", "nothing"]
    want = ["USE it", "Use it", "use it", "Advanced advanced", "used robustly", "nothing"]
    assert values(rows, "s string", lambda c: casing.replace_banned(c("s"))) == want


def test_normalize_block(values):
    rows = ["leveraging the cloud", "• Utilize robust tools, and more words so that this is a bullet.", "  "]
    want = ["Using the Cloud", "• Use reliable tools, and more words so that this is a bullet", "  "]
    assert values(rows, "s string", lambda c: casing.normalize_block(c("s"))) == want


def test_unescape(values):
    rows = ["&lt;tag&gt; &amp; &quot;x&quot;", "&#x3042;&#12354;", "&amp;lt;", "&#1114112;", "plain", "&#38;lt; &middot;&copy; &nope; &"]
    want = ['<tag> & "x"', "ああ", "&lt;", "�", "plain", "&lt; ·© &nope; &"]
    assert values(rows, "s string", lambda c: text.unescape_markup(c("s"))) == want


def test_mask_stages(values):
    rows = ["see https://a.b/c1 and 3,5% of AB12-X by me@ex.org", "⟦x⟧ 7", "none", "AB-12 is 12"]
    got = values(rows, "s string", lambda c: masking.mask_fragile(c("s")))
    assert got[0]["masked"] == "see ⟦URL_1⟧ and ⟦NUM_1⟧ of ⟦CODE_1⟧ by ⟦URL_2⟧"
    assert got[0]["marks"]["⟦URL_2⟧"] == "me@ex.org" and got[0]["marks"]["⟦CODE_1⟧"] == "AB12-X"
    assert got[1]["masked"] == "⟦x⟧ ⟦NUM_1⟧"
    assert got[2]["masked"] == "none" and got[2]["marks"] == {}
    assert got[3]["masked"] == "AB-⟦NUM_1⟧ is ⟦NUM_2⟧"
    back = values(rows, "s string", lambda c: text.let(
        masking.mask_fragile(c("s")), lambda m: masking.unmask_fragile(m["masked"], m["marks"])))
    assert back == rows


@pytest.mark.parametrize(
    "source, kind, stub, notes",
    [
        ("One. Two! Three", "bullet", "One. (detail → Notes)", "Additional details: Two! Three"),
        ("first part, and second part", "bullet", "first part (detail → Notes)", "Additional details: second part"),
        ("one two three four five", "bullet", "one two (more → Notes)", "Continued: three four five"),
        ("a b c d e f", "table", "a b c... (Notes)", "Full content: a b c d e f"),
        ("a b c", "table", "a b c", ""),
        ("a b c d e f g h i", "body", "a b c d e f (→Notes)", "Complete text: a b c d e f g h i"),
        ("short title", "title", "short title", ""),
        ("word " * 16 + "x", "title", ("word " * 15).strip() + "...", "Full title: " + "word " * 16 + "x"),
    ],
)
def test_spill(values, source, kind, stub, notes):
    (got,) = values([(source, kind)], "s string, k string", lambda c: length.spill_to_notes(c("s"), c("k")))
    assert (got["stub"], got["notes"]) == (stub, notes)


def test_spill_title_matches_word_loop(values):
    """Against a plain count of words for many lengths."""
    titles = [" ".join("w" * (1 + (i * 7 + j) % 11) for j in range(20)) for i in range(40)] + ["x" * 90]
    got = values([(t, "title") for t in titles], "s string, k string", lambda c: length.spill_to_notes(c("s"), c("k")))
    for title, row in zip(titles, got):
        size, kept = 0, []
        for word in title.split():
            size += len(word) + 1
            if size > 75:
                break
            kept.append(word)
        assert row["stub"] == " ".join(kept) + "..."


def test_spill_last_sentence(values):
    (got,) = values(["A b. C d. E"], "s string", lambda c: length.spill_last_sentence(c("s")))
    assert got["stub"] == "A b. C d. (details → Notes)"
    assert got["notes"] == "Additional details:\nE\n"


def test_ratio_and_thresholds(values):
    rows = [("日本", " abc ", "title"), ("", "x", "table"), ("ab", "abc", "other")]
    ratios = values(rows, "s string, t string, k string", lambda c: length.expansion_ratio(c("s"), c("t")))
    assert ratios == [1.5, 1.0, 1.5]
    limits = values(rows, "s string, t string, k string", lambda c: length.length_threshold(c("k")))
    assert limits == [1.8, 1.2, 1.4]


def test_counts_preserved(values):
    rows = [("10% と 2,000", "10% and 3,000"), ("1 http://a", "1")]
    assert values(rows, "s string, t string", lambda c: length.counts_preserved(c("s"), c("t"))) == [True, False]
    assert values(rows, "s string, t string", lambda c: length.counts_preserved(c("s"), c("t"), True)) == [False, False]


def test_patterns_compile_in_python_too():
    for phrase in rules.BANNED_PHRASES:
        assert re.compile(rf"\b{re.escape(phrase)}\b")


def test_references_equal_the_standard_library(values):
    """All numbers of interest, all names with and without semicolon, and drawn mixtures."""
    import html
    import random
    from html.entities import html5

    r = random.Random(6)
    numbers = [*range(0, 170), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFE, 0x10FFFF, 0x110000, 10**7, 10**30]
    texts = [f"a&#{n}{end}b" for n in numbers for end in (";", "")] + [f"&#{x}{n:x};&#x{'0' * 12}{n:X}z" for n in numbers for x in "xX"]
    texts += [f"&{name}" for name in html5] + [f"x&{name.rstrip(';')} y" for name in r.sample(sorted(html5), 300)]
    texts += ["&copy 2020 &#128;", "&#000000065;", "&notit;", "&notin;", "&amp;lt;", "&;", "&#;", "&#x;", "&#xg;", "&&amp;&", "& amp;", "R&D", "&" + "a" * 40 + ";", "&ampamp;", "&AMP;x"]
    pieces = ["&", "#", "x", ";", "amp", "lt", "copy", "not", "in", "65", "0", "é", " ", "frac12", "&#", "&#x", "8", "f"]
    texts += ["".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(1500)]
    got = values(texts, "s string", lambda c: text.unescape_markup(c("s")))
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []
