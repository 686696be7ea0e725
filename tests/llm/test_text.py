from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from stratafold.llm import _text
from stratafold.llm._text import ALNUM, NONSPACE, Words

from .util import alnum_words, space_words

TEXT = st.text(st.characters(codec="utf-8"), max_size=60) | st.text(st.sampled_from("aAbBzZ09 \n\t.-_é日\x7f\x1c"), max_size=60)


@given(st.lists(TEXT | st.none(), max_size=6), st.integers(4, 64))
def test_words_and_hashes(texts, segment):
    before, _text.SEGMENT = _text.SEGMENT, segment
    try:
        for table, plain in ((ALNUM, alnum_words), (NONSPACE, space_words)):
            w = Words([None if t is None else t.encode() for t in texts], table)
            found = [[x.decode() for x in w.strings(a, b)] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
            assert found == [plain(t) for t in texts]
            by_word: dict[str, set[int]] = {}
            for x, h in zip([x for ws in found for x in ws], w.hashes.tolist(), strict=True):
                by_word.setdefault(x, set()).add(h)
            assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    finally:
        _text.SEGMENT = before


@given(st.lists(st.binary(max_size=9) | st.none(), max_size=12))
def test_groups_cover_all_texts(texts):
    ranges = list(_text.groups(texts, 10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(texts)))
