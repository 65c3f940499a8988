import numpy as np
import pytest

from ctxspark.llm import sentences as s

DOC = "doc_id long, text string, lang string, start_char string"
# Sentences to be found, joined to documents in many orders so that the counts of block edges have something to go by.
PLAIN = ["The index must not be written twice.", "Dr. Weller asked for a new list.", "See Fig. 12 and No. 3 in the notes.", "We measured 4.5 ms per run.", "Why does it fail?", "Stop!",
         'The log said "no file. Retry later." and stopped.', "That covers lists, maps, etc.", "(The other case is handled in main.py.)", "“Leave it.” was the only comment.", "It failed... then it came back.",
         "Run it with approx. 40 lines.", "Please keep the list, i.e. the short one.", "parseIndex returns a list.", "The build at 9 a.m. used v1.2.3."]
OTHERS = ["这个窗口太大了……但是可以用。", "他写道：“空的。请重试。”然后走了。", "（详见第 3 节。）", "真的吗？！", "「本当？」という質問です。", "नया परीक्षण जोड़ा।", "«Готово?» спросил он.", "هل هو جاهز؟"]


def test_sentences_across_languages(spark):
    rng = np.random.default_rng(0)
    docs, want = [], set()
    for d in range(250):
        text = ""
        for _ in range(4):
            part = [str(x) for x in rng.choice(PLAIN if d % 3 else OTHERS, rng.integers(1, 5))]
            for n, x in enumerate(part):
                want.add((d, len(text), len(text) + len(x)))
                text += x + ("\n\n" if n == len(part) - 1 else " " if rng.random() < 0.8 else "\n")
        docs.append((d, text, "xx", "clash"))
    got = {tuple(r) for r in s.sentences(spark.createDataFrame(docs + docs[:5], DOC)).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


@pytest.mark.parametrize("text, units", [
    ("# A heading. Of two\n\n- One. Two!\n2. Three\n\ntail without end", ["A heading. Of two", "One.", "Two!", "Three", "tail without end"]),
    ("Title\n=====\n```py\nx = 1. Y\n```\nAfter it!\r\n\r\nEnd?  Yes!", ["Title", "After it!", "End?", "Yes!"]),
    ("แคชเก่าถูกลบแล้ว ไฟล์ a.py มี 12 บรรทัด ผู้ตรวจสอบตอบ", ["แคชเก่าถูกลบแล้ว", "ไฟล์ a.py มี 12 บรรทัด", "ผู้ตรวจสอบตอบ"]),
    ("« Prêt ? » demande-t-elle. Attention !", ["« Prêt ? » demande-t-elle.", "Attention !"]),
    ("> quoted line\n> goes on!\n\n---\n\n* item\n  more of it", ["quoted line\n> goes on!", "item\n  more of it"]),
    ("```\nnever closed. Text", []), ("", []), (" \n\t", []),
])
def test_blocks(spark, text, units):
    got = s.sentences(spark.createDataFrame([(1, text, "en", "x"), (2, None, None, "x")], DOC)).orderBy("start_char").collect()
    assert [text[r.start_char:r.end_char] for r in got if r.doc_id == 1] == units


def test_offsets_are_code_points_and_long_texts_whole(spark):
    text = "🙂 ok! " * 20_000
    got = s.sentences(spark.createDataFrame([(1, text, "en", "x")], DOC)).orderBy("start_char").collect()
    assert len(got) == 20_000 and all(text[r.start_char:r.end_char] == "🙂 ok!" for r in got[:50] + got[-50:])


def test_empty_table(spark):
    assert s.sentences(spark.createDataFrame([], DOC)).count() == 0


def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(4)
    x = np.c_[np.ones(4000), rng.standard_normal((4000, 3))]
    y = (x @ [0.3, 2, -1, 0.5] + 0.3 * rng.standard_normal(4000) > 0).astype(float)
    w = s.fitted(x[:3000], y[:3000])
    assert (((x[3000:] @ w) > 0) == y[3000:]).mean() > 0.93
