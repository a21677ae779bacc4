"""A reused worker gives back what other operators remember there."""

from quarry.llm import common, quality


def test_a_new_scorer_empties_what_others_remember():
    kept = {"encoder": bytes(10)}
    common.remembers("test other", kept.clear)
    try:
        quality._SCORERS.clear()
        first = quality._scorer(b"good words " * 9, b"bad words " * 9)
        assert not kept and quality._scorer(b"good words " * 9, b"bad words " * 9) is first
        kept["encoder"] = b""
        quality._scorer(b"other", b"words")
        assert not kept and len(quality._SCORERS) == 1
    finally:
        common._REMEMBERED.pop("test other")
        quality._SCORERS.clear()
