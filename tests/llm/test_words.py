import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from framewell.llm import words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("aZ0_.,-\x00\x1b\x7fΣİß…“”")), max_size=8), max_size=12))
def test_many_words_are_bared_as_one_is(some):
    some = [w.replace(" ", "") for w in some]  # words hold no white space
    assert words.bared(pa.array(some, pa.string())).to_pylist() == [words.bare(w) for w in some]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_of_documents(texts):
    found = words.normal(words.split(pa.array(texts, pa.string())))
    same = words.normalised(pa.array(texts, pa.string()))
    assert (same.starts == found.starts).all() and [same.distinct[i] for i in same.ids] == [found.distinct[i] for i in found.ids]
    assert len(set(found.distinct)) == len(found.distinct)
    for k, text in enumerate(texts):
        plain = [words.bare(w) for w in pa.compute.utf8_split_whitespace(pa.array([text]))[0].as_py()]
        assert [found.distinct[i] for i in found.ids[found.starts[k] : found.starts[k + 1]]] == [w for w in plain if w]
    assert (np.diff(found.starts) >= 0).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\r\x1c\x85aZ.-ΣςİßÉ“")), max_size=40)), max_size=6))
def test_keyed_words_are_the_hashes_of_normalised_ones(texts):
    column = pa.array([t or "" for t in texts], pa.string())
    found, same = words.keyed(column), words.normalised(column)
    assert found.starts.tolist() == same.starts.tolist() and found.keys.tolist() == words.hashes(same.distinct).tolist()
    assert found.ids.tolist() == same.ids.tolist()
