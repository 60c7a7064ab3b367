"""Quality rules on small documents, against a loop over words and lines."""

from __future__ import annotations

import re
from collections import Counter

from rollcall.llm.quality_rules import LineRule, assessed, filtered

SCHEMA = "doc_id long, text string, source string, n_chars int, lines string"


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if count[run] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures(spark):
    texts = [
        None, "", " \n\t", "one", "a b c d e a b c d e f", "x x x x x x x", "a\na\n\n\nA\n a", "é#*\x0b$ %&|<>\x1fz",
        "w " * 3000, " ".join(f"w{i}" for i in range(4000)) + "\n" + " ".join(f"w{i}" for i in range(50, 90)), "𝒳𝒴 ça\r\nb",
    ]
    rows = [(i, t, "h", 0, "x") for i, t in enumerate(texts)] + [(None, "one", None, 0, "x")] * 2
    found = assessed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "one" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(text), text
    assert assessed(spark.createDataFrame([], SCHEMA)).count() == 0


def body(i, n=30):
    spelled = lambda x: "".join("abcdefghij"[int(c)] for c in str(x))
    return " ".join(f"w{spelled(i)}x{spelled(k)}" for k in range(n))


def test_frequent_lines_are_removed_per_host(spark):
    notice = "Share  this PAGE 12 now with all"
    rows = [(i, f"{body(i)}\n{notice if i % 2 else notice.upper().replace('12', '7')}", "a", 0, None) for i in range(8)]
    rows += [(100, f"{body(100)}\n{notice}", "b", 0, None), (101, f"{notice}\n{notice}\none two three four", "a", 0, None)]
    # thousands of copies of one text do not make its lines frequent
    rows += [(200 + i, f"{body(300)}\n{body(301)}" if i else f"{body(300)} edited\n{body(301)}", "a", 0, None) for i in range(50)]
    rows += [(rows[0][0], *rows[0][1:])]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r for r in filtered(frame, LineRule(share=0.0)).collect()}
    assert [r.doc_id for r in filtered(frame, LineRule(share=0.0)).collect()].count(0) == 2
    assert {i for i in range(8)} | {100} | {200 + i for i in range(50)} == set(kept)
    assert kept[3].text == body(3) and kept[3].n_chars == len(body(3)) and kept[100].text == rows[8][1]
    assert kept[220].text == rows[30][1] and kept[200].text.endswith(body(301))
    assert filtered(frame).columns == frame.columns


def test_a_notice_does_not_hide_itself(spark):
    notices = {"a": "unquestionably incomprehensible counterrevolutionaries misrepresented internationalization everywhere", "b": "to be or not to be so"}
    rows = [(k, f"{body(1000 * (1 + k) + (host == 'b'))}\n{notice}", host, 0, None) for k in range(100) for host, notice in notices.items()]
    kept = filtered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == 200 and not any("\n" in r.text for r in kept)


def test_clashing_names_and_an_empty_table(spark):
    schema = "doc_id long, text string, source string, print_0 int, removed_lines string, kept boolean, n_chars int"
    rows = [(k, f"{body(k)}\nthe same line everywhere it is", "a", 1, "x", False, 0) for k in range(6)] + [(9, None, None, 2, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    found = filtered(frame)
    assert found.schema == frame.schema and {r.text for r in found.collect()} == {body(k) for k in range(6)}
    assert filtered(spark.createDataFrame([], schema)).count() == 0
