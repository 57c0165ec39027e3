"""Base counts against brute force, measures against the libraries, verdicts on planted junk."""

import math
import re
from collections import Counter

import pytest
import sentencepiece
from fixtures import by_id, enumerated, texts
from public_tokenizers import path

from tessera.llm.fertility import fertility_rules, length_runs, script_of


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if win[tuple(words[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit),
            n < 10 or 100 * len(hit) > 20 * n)


def test_base_counts(spark):
    values = texts(6) + ["a b\na b\n\na b \nx\n\n  \n\t\n" * 3, "#*$ %& <> | é<" * 5]
    got = by_id(fertility_rules(enumerated(spark, values)))
    for i, t in enumerate(values):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t
        assert not (r["kept"] and r["base_failed"])


def test_measures(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    values = [" ".join(f"word{i} naïve 語 🙂x" for i in range(5)), "plain words only here", ""]
    got = by_id(fertility_rules(enumerated(spark, values)))
    for i, t in enumerate(values):
        tokens = [x for w in t.split() for x in model.encode(w)]
        count = Counter(tokens)
        n = len(tokens)
        h = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0
        r = got[i]
        assert r["n_tokens_0"] == n
        if n:
            assert r["chars_per_token_0"] == pytest.approx(sum(map(len, t.split())) / n)
            assert r["byte_share_0"] == pytest.approx(sum(map(model.is_byte, tokens)) / n)
            assert r["entropy_0"] == pytest.approx(h / math.log2(n))


def test_bands_reject_junk(spark):
    import random

    rnd = random.Random(0)
    common = "the of and to in is that for it was on are as with they at be this from have or by one had not but what all".split()
    values = [" ".join(rnd.choices(common, k=60)) for _ in range(120)]
    values += ["".join(rnd.choices("qxzjkvw#%", k=8)) + " " + " ".join("".join(rnd.choices("qxzjkvw#%", k=8)) for _ in range(59))
               for _ in range(4)]
    got = by_id(fertility_rules(enumerated(spark, values)))
    assert all(got[i]["kept"] for i in range(120) if not got[i]["base_failed"])
    assert all(not got[i]["kept"] and got[i]["rejected_by"] for i in range(120, 124))


def test_sparse_classes_stay_in_their_language(spark):
    """A rare length class of a language is judged by the language, not by all texts of its length."""
    import random

    from fixtures import documents

    rnd = random.Random(1)
    common = "the of and to in is that for it was on are as with they at be this from have or by one had not but what all".split()
    noise = lambda n: " ".join("".join(rnd.choices("qxzjkvw#%", k=8)) for _ in range(n))
    usual = [(" ".join(rnd.choices(common, k=k)), "en") for k in [*range(45, 60)] * 6 + [*range(70, 120)] * 2 + [200] * 6]
    other = [(noise(rnd.randint(40, 80)), "zz") for _ in range(120)]
    junk = [(noise(60), "en") for _ in range(3)]
    rows = usual + other + junk
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id bigint, lang string")
    got = by_id(fertility_rules(docs.join(langs, "doc_id")))
    assert all(got[i]["kept"] for i in range(len(usual) + len(other)) if not got[i]["base_failed"])
    assert any(not got[i]["base_failed"] for i in range(190, 196))
    assert all(got[i]["rejected_by"] for i in range(len(usual) + len(other), len(rows)))


def test_short_texts_are_judged(spark):
    """Texts of 10 to 39 tokens: usual ones stay, in classes of their own or beside longer ones, and junk goes."""
    import random

    rnd = random.Random(2)
    common = ("morning people water another school because little should number always before through between country "
              "thought example together important children without family always second enough almost above").split()
    junk = [" ".join(rnd.choices("#*$%&|<>", k=k)) + " q" for k in (11, 18, 25)]
    for sizes in ([*range(11, 36)] * 8, [*range(45, 75)] * 4 + [12, 20, 30]):
        usual = [" ".join(rnd.choices(common, k=k)) for k in sizes]
        got = by_id(fertility_rules(enumerated(spark, usual + junk)))
        assert all(got[i]["kept"] for i in range(len(usual)) if not got[i]["base_failed"])
        for i in range(len(usual), len(got)):
            assert got[i]["n_tokens_0"] < 40 and got[i]["rejected_by"] and not got[i]["kept"]


def test_length_runs():
    assert length_runs([(6, 20), (7, 90), (8, 3), (9, 30), (10, 25), (11, 2)], 50) == [
        (7, [7], [7]), (8, [8, 9, 10], [8, 9, 10]), (6, [6], [6, 7]), (11, [11], [8, 9, 10, 11])]
    assert length_runs([(5, 20), (6, 29)], 50) == []
    assert length_runs([(5, 20), (6, 0), (9, 30)], 50) == [(5, [5, 6, 9], [5, 6, 9])]


def test_scripts_and_empty(spark):
    assert [script_of(t) for t in ("abc é", "αβγ a", "дом", "漢字", "12 #")] == ["latin", "greek", "cyrillic", "han", "none"]
    assert fertility_rules(enumerated(spark, [])).count() == 0
    docs = enumerated(spark, ["дом " * 12, None]).drop("lang")
    assert by_id(fertility_rules(docs, lang_col=None))[0]["band_group"] == "script:cyrillic"
