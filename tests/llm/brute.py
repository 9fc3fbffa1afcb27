"""Plain versions of the queries' definitions, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_duplicates(docs):
    """doc_id: (n_shingles, component_id), by comparing all that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    shared = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def token_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts],
                                                  add_special_tokens=False)]


def token_rows(docs):
    rows, start = {}, 0
    docs = sorted(docs)
    for (d, _), ids in zip(docs, token_ids([t for _, t in docs])):
        ids = [*ids, 1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        rows[d] = (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    return rows


def secret_spans(text):
    """(kind, start, end) of the base kinds, by start and then kind."""
    text, found = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                        r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text)
              if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_leaf(row):
    """The leaf of (doc_id, source, lang, n_chars, text)."""
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return hashed("".join(values))


def merkle_tree(leaves, fan):
    """The root of a tree, and for each leaf the (left, right) hashes on every level."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place - place % fan
            steps[i].append(("".join(level[first:place]), "".join(level[place + 1:first + fan])))
        level = [hashed("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
        at = [place // fan for place in at]
    return level[0], steps


def merkle_rows(docs, fan=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of documents rows."""
    by_source = defaultdict(list)
    for row in docs:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, merkle_leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda x: x[:3]) for s in sources}
    built = {s: merkle_tree([x[2] for x in trees[s]], fan) for s in sources}
    if not sources:
        return []
    root, above = merkle_tree([built[s][0] for s in sources], fan)
    out = []
    for s, upper in zip(sources, above):
        for (_, _, leaf, row), own in zip(trees[s], built[s][1]):
            steps, at = own + upper, leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4]:
                at = merkle_leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in steps:
                at = hashed(left + at + right)
            proof = hashed("".join(left + right for left, right in steps))
            out.append((row[0], leaf, built[s][0], root, proof, at, at == root))
    return sorted(out, key=str)


def spelling_rows(docs):
    """word: (n, n_near, form, form_n, root), by trying every edit of every word."""
    counts = defaultdict(int)
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(counts)))
    near = {}
    for w in counts:
        edits = set()
        for i in range(len(w) + 1):
            edits.update(w[:i] + c + w[i:] for c in letters)
            edits.update(w[:i] + c + w[i + 1:] for c in ["", *letters])
        near[w] = sorted((-counts[x], x) for x in edits - {w} if x in counts)
    form = {w: f[0][1] if f and -f[0][0] >= 5 * counts[w] else None for w, f in near.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out
