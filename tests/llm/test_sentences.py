import pytest

from lodestrata.llm.sentences import split_sentences, units

CASES = [
    ("Dr. Brandel measured 422 outlines. Call `x_y` first.", 2), ("Wait… then retry with 443 clusters. We saw it in vol. 3, pp. 12-19, of the notes.", 2), ("The fallback ... if there is one ... queues it.", 1),
    ('The log said "delivery is early. Rebuild it." and the pool went on.', 1), ('They call it "the local edge." Mr. Velm agrees.', 2), ('"Keep it shared!" was the only comment.', 1), ("It went on.Call `flush` first.", 2), ("Stop at 3.90? The next.", 2),
    ("No. 107 in the list is stale, cf. Route. rustc-style names stay.", 2), ("It lists turns, sessions, etc. By default it waits.", 2), ("Удалённые векторы, ссылки и т. д. убирает `x`. См. рис. 2.", 2), ("Die Prüfung läuft z. B. nach jedem Start. Am 3. März kam sie, usw. Bitte nicht!", 3),
    ("記録には「節が古い。作り直すこと。」と残っていた。本当に必要なのか？！", 2), ("日志写着“章节已过期。请重建。”，然后继续运行。版本2.0的预算是3.5倍。", 2), ("Γιατί σταματά το `x` στο 1.20; Μην αλλάζετε το a.md!", 2), ("ทำไมจึงหยุดที่723 ดัชนีเก็บส่วน", 2),
    ("기록에는 \"절이 오래됨. 다시 만들 것.\"이라고 남았다. 왜 멈추나요?", 2), ("سؤال؟ جواب.", 2), ("सूचकांक में 78 खंड हैं। अगला।", 2), ("Pourquoi `x` s'arrête-t-il à 0.5% ? Mme Velm compte 3,5 % de doublons.", 2), ("See https://docs.example.org/a/b.html. Then go.", 2), ("(It waits 5 s (max. 9 s).) Next one.", 2), ("The U.S. mirror at 7:14 p.m. the count fell.", 1),
    ("Certains appels, p. ex. `x_y`, ne passent jamais. Non !", 2), ("Guarda 7 en memoria, p. ej. las de lib/xy. Sí.", 2), ("En mémoire, c.-à-d. environ 3 Mo. Il faut 2.", 2), ("Насчитал ок. 121 фрагментов. Да.", 2), ("See lib/" + "a" * 90 + ".b.Next one", 1), ("Call " + "a" * 60 + "_box. then go", 2),
]


@pytest.mark.parametrize("text,n", CASES)
def test_counts(text, n):
    found = units(text)
    assert len(found) == n, [text[a:b] for a, b in found]


def test_blocks():
    text = "# Head line\n\nOne sentence\nover two lines. Two.\n\n- item one. still it\n* item two\n1. third\n"
    assert [text[a:b] for a, b in units(text)] == ["Head line", "One sentence\nover two lines.", "Two.", "item one. still it", "item two", "third"]


def test_edges(spark):
    assert units(None) == [] and units("") == [] and units(" \n\n ") == [] and units("#") == [] and units("...") == [(0, 3)]
    text = "Some words here. " * 50_000
    assert len(units(text)) == 50_000
    df = spark.createDataFrame([(1, "A box. Can do.", 5), (1, "A box. Can do.", 5), (2, None, 1), (3, "", 1), (None, "X.", 1)], "doc_id bigint, text string, start_char int")
    got = sorted((r.doc_id or 0, r.start_char, r.end_char) for r in split_sentences(df).collect())
    assert got == [(0, 0, 2), (1, 0, 6), (1, 0, 6), (1, 7, 14), (1, 7, 14)]
    assert split_sentences(df.limit(0)).count() == 0
