import hashlib
import zlib

import pytest

from assay.llm import merkle


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        s = i // 8 * 8
        yield level[s:i], level[i + 1 : s + 8]
        i //= 8


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    root = top[-1][0]
    for at, g in enumerate(order):
        for i, (*_, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*way(trees[g], i), *way(top, at)]
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for a, b in path:
                h = digest(*a, h, *b)
            yield r.doc_id, own, trees[g][-1][0], root, digest(*(x for a, b in path for x in a + b)), h, h == root


def in_a_row(rows):
    return sorted(rows, key=lambda t: [(x is not None, x if x is not None else 0) for x in t])


@pytest.mark.parametrize("span", [1, 2, 4])
def test_folds_against_brute_force(spark, docs, span):
    capital = docs.selectExpr("doc_id", "concat('A', text) AS text", "CASE WHEN doc_id % 7 = 0 THEN 'Zü' ELSE lang END AS lang", "source", "n_chars", "`a.b`")
    got = merkle.tamper_check(capital, span=span).collect()
    expected = in_a_row(brute_force(capital.collect()))
    assert in_a_row([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]) == expected
    assert {x[-1] for x in expected} == {True, False}


def test_lone_leaf_and_no_leaf(spark, empty):
    one = spark.createDataFrame([(3, "Text", None, "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.tamper_check(one).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest()
    assert merkle.tamper_check(empty).count() == 0


def test_a_parent_folds_from_the_state_before_the_slot():
    children = [digest(str(i)).encode() for i in range(5)]
    parent = merkle.Parent(b"".join(children))
    for slot in range(5):
        new = digest("new").encode()
        assert parent.fold(slot, new).decode() == hashlib.sha256(b"".join([*children[:slot], new, *children[slot + 1 :]])).hexdigest()
        seen = parent.states[slot].copy()
        assert seen.hexdigest() == hashlib.sha256(b"".join(children[:slot])).hexdigest()  # the state holds what lies to the left


def test_manifest_names_the_root(spark, docs):
    rows = docs.select("doc_id", "lang", merkle.leaf_of(docs["doc_id"], docs["text"]).alias("digest"))
    a, b = merkle.build(rows), merkle.build(rows.repartition(3), span=2)
    assert a.root() == b.root() and len(a.root()) == 64
    assert merkle.build(rows.filter("doc_id > 3")).root() != a.root()
