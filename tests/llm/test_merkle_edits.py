"""Deleted, moved and swapped paragraphs leave places, and node hashes cover those below them."""

from tidemark.llm import merkle

LINES = [f"paragraph {i} with some words in it and more of them" for i in range(60)]


def printed(lines):
    return merkle.written(merkle.tree("\n".join(lines).encode()))


def numbers(fingerprint, places, side):
    sections = merkle.parsed(fingerprint)[1]
    return [sum(map(len, sections[:i])) + j for i, j, s in places if s == side]


def test_deletions_and_moves():
    a = printed(LINES)
    gone = printed(LINES[:20] + LINES[21:])
    assert numbers(a, merkle.edits(a, gone), "old") == [20] and numbers(gone, merkle.edits(a, gone), "new") == []
    cut = printed(LINES[:50])
    assert numbers(a, merkle.edits(a, cut), "old") == list(range(50, 60))
    moved = printed(LINES[:5] + LINES[6:40] + [LINES[5]] + LINES[40:])
    places = merkle.edits(a, moved)
    assert numbers(a, places, "old") == [5] and numbers(moved, places, "new") == [39]
    swapped = printed([*LINES[:30], LINES[31], LINES[30], *LINES[32:]])
    assert merkle.edits(a, swapped)
    assert merkle.edits(a, a) == []


def test_nodes_cover_what_is_below():
    root, sections = merkle.nodes(printed(LINES))
    changed_root, changed = merkle.nodes(printed([*LINES[:30], "another", *LINES[31:]]))
    assert len(sections) > 2 and root != changed_root
    assert sum(len(s[1]) for s in sections) == 60 and {s[0] for s in sections} & {s[0] for s in changed}
    assert all(h in [s[0] for s in changed] for h, p in sections if (h, p) in changed)
