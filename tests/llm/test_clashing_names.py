"""Columns of the caller whose names the operators might use themselves."""

import public_tokenizers
import pytest

from tessera.llm.decontaminate import decontaminated
from tessera.llm.jaccard_groups import one_of_each
from tessera.llm.mixing import mixed
from tessera.llm.token_planes import WordIds

NAMES = ["copies", "copy", "_id", "_size", "_source", "_n", "_k", "id", "size", "whole", "k", "n", "_key", "_row", "_rid", "_spans", "_over", "rid",
         "spans", "_KEY_", "row", "key"]
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, 1, None, None]])
def test_clashes(spark, ids):
    texts = ["one two three four five six", "one two three four five six", f"say {LEAK} and more words stand here than are cut out of it " * 2, None]
    rows = [(i, t, "s", *[f"{c}{k}" for c in NAMES]) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES))
    key = lambda r: tuple(map(str, r))
    single = one_of_each(docs)
    assert single.columns == docs.columns
    left = single.collect()
    assert len(left) == 3 and {r.copies for r in left} <= {f"copies{k}" for k in range(4)}
    items = spark.createDataFrame([(1, LEAK)], "item_id bigint, text string")
    clean = decontaminated(docs, items)
    assert clean.columns == docs.columns
    got = {r._spans: r.text for r in clean.collect()}
    assert len(got) == 4 and got["_spans0"] == texts[0] and got["_spans3"] is None and LEAK not in got["_spans2"]
    taken = mixed(docs, budget=10 ** 6)  # room for three copies of all
    assert taken.columns == docs.columns
    want = sorted([key(r) for r in docs.collect() if r.text] * 3 + [key(r) for r in docs.collect() if not r.text])
    assert sorted(map(key, taken.collect())) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_are_refused(name):
    with pytest.raises(ValueError):
        WordIds(public_tokenizers.path(name))
