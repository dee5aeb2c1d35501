"""Neighbouring chunks that fold to a known word, against every stretch tried in turn."""

from tidemark.llm import toxicity


def test_stretches_and_kept_folds():
    lexicon = toxicity.Lexicon(["idiot ", "stupid ", "loser "])
    texts = [b"", b" ", b"you id iot and st upid", b"i d i o t !", b"l 0 s e r lo ser", b"st - upid id", b"plain words only", b"x" * 80 + b" lo ser"]
    for raw in texts:
        chunks = toxicity.chunks_of(raw)
        parts, want = " ".join(chunks).split(" "), []
        for at in range(len(parts)):
            for end in range(at + 2, len(parts) + 1):
                if toxicity.folded(parts[at]) and toxicity.folded(parts[end - 1]) and toxicity.folded("".join(parts[at:end])) in lexicon.words:
                    want.append(" ".join(parts[at:end]))
        assert list(lexicon.stretches(chunks)) == want
    assert isinstance(lexicon.kept, toxicity.Folds) and "x" * 80 not in lexicon.kept and lexicon.kept["L0SER"] == toxicity.folded("L0SER")
