import hashlib
import random

from llm.conftest import EDGES, LONG

from catalpa.llm import merkle


def brute(rows):
    """(id, edited text, next text) by descending id, nulls last, then text."""
    ordered = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        out.append((i, text[: len(text) - n] + after[:n], text, after))
    return out


def pieces_by_hand(line):
    """A line's pieces, sign by sign: up to 64 signs that end no sentence, the ends after them, a blank, a line break."""
    out, i = [], 0
    while i < len(line):
        j = i
        if line[j] == "\n":
            j += 1
        else:
            stops = line[j] in ".!?"
            while j < len(line) and j - i < 64 and line[j] != "\n" and (line[j] in ".!?") == stops:
                j += 1
            while not stops and j < len(line) and line[j] in ".!?":
                j += 1
            j += j < len(line) and line[j] in " \t"
            j += j < len(line) and line[j] == "\n"
        out.append(line[i:j])
        i = j
    return out


def sections_by_hand(text):
    """The text cut after each line that is followed by blank ones, these included."""
    lines, out, own = [x + "\n" for x in text.split("\n")], [], ""
    lines[-1] = lines[-1][:-1]
    i = 0
    while i < len(lines):
        own += lines[i]
        if lines[i].endswith("\n") and i + 1 < len(lines) and lines[i + 1].endswith("\n") and not lines[i + 1].strip(" \t\n"):
            i += 1
            own += lines[i]
            while i + 1 < len(lines) and lines[i + 1] == "\n":
                i += 1
                own += lines[i]
            out.append(own)
            own = ""
        i += 1
    return out + [own] if own or not out else out


def by_hand(text):
    """(root, leaves) of the tree, from its definition."""
    node = lambda *parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    root, leaves = [], []
    for section in sections_by_hand(text):
        inner = []
        lines = section.split("\n")
        for k, line in enumerate(lines):
            line += "\n" if k < len(lines) - 1 else ""
            if line or not section:
                own = [node(p.encode()) for p in (pieces_by_hand(line) or [""])]
                leaves += [leaf[:4].hex() for leaf in own]
                inner.append(node(b"P", *own))
        root.append(node(b"S", *inner))
    return node(b"R", *root).hex(), leaves


def likeness_by_hand(a, b):
    (root, left), (other, right) = by_hand(a), by_hand(b)
    if root == other:
        return 1.0
    common, rest = 0, sorted(right)
    for leaf in left:
        if leaf in rest:
            rest.remove(leaf)
            common += 1
    return min(2 * common / (len(left) + len(right)), 1 - 1e-9)


def test_tree_and_likeness_by_hand():
    rng = random.Random(9)
    texts = ["", "\n", "\n\n", " \n \n\n x", "a" * 200, "..." * 50, LONG[:3000]] + ["".join(rng.choice(["ab", "c d", ". ", "! ", "?", "\n", "\n", " ", "\t", "w" * 40, "é"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    for text, other in zip(texts, texts[1:] + texts[:1]):
        root, leaves = by_hand(text)
        mark = merkle.fingerprint(text)
        assert mark.partition(":")[0] == root and merkle.leaves_of(mark) == leaves, text
        assert merkle.likeness(mark, merkle.fingerprint(other)) == likeness_by_hand(text, other)
        assert merkle.likeness(mark, merkle.fingerprint(merkle.edited(text, other))) == likeness_by_hand(text, text[: len(text) - len(text) // 3] + other[: len(text) // 3])


def check(rows, out):
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(e), likeness_by_hand(t, a)) for i, e, t, a in brute(rows))
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in out)
    assert got == want


def test_next_documents_across_buckets(make):
    rng = random.Random(5)
    rows = [(7 * i, " ".join(rng.choice(["one.", "two", "three\n", "four\n\n"]) for _ in range(rng.randint(0, 60))), "en", "a") for i in range(300)]
    rng.shuffle(rows)
    check(rows, merkle.fingerprints(make(rows)).collect())


def test_edges(make):
    docs = make(EDGES, clash=True)
    out = merkle.fingerprints(docs).collect()
    check(EDGES, out)
    assert merkle.fingerprints(docs.where("false")).count() == 0
    one = merkle.fingerprints(docs.where("doc_id = 5")).collect()
    check([EDGES[5]], one)
    assert one[0]["near_next"] == 1.0


def test_tree():
    text = "Title\n\nFirst paragraph. It has two sentences.\nSecond one.\n\n\nAnother section without an end"
    sections = merkle.tree(text)
    assert [len(s) for s in sections] == [2, 3, 1] or len(sections) == 3
    assert "".join("".join(merkle.PIECE.findall(t)) for t in (text, LONG, "", "\n\n\n")) == text + LONG + "\n\n\n"
    a, b = merkle.fingerprint(text), merkle.fingerprint(text.replace("Second one", "Second two"))
    assert a.partition(":")[0] != b.partition(":")[0] and merkle.edits(a, a) == []
    (section, _), = merkle.edits(a, b)
    assert section == 1 and 0.5 < merkle.likeness(a, b) < 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0 and merkle.likeness(merkle.fingerprint(""), a) == 0.0
