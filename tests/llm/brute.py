"""Plain versions of the operators, on lists of rows, to hold the results against."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {code: code + 32 for code in range(65, 91)}


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 4]) for at in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for shingle in shingles:
        digest = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            counts[bit] += digest >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def components(prints, radius):
    """Return the root of each print by comparing all pairs."""
    prints = sorted(set(prints))
    root = {one: one for one in prints}

    def find(one):
        while root[one] != one:
            root[one] = root[root[one]]
            one = root[one]
        return one

    for at, a in enumerate(prints):
        for b in prints[:at]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {one: find(one) for one in prints}


def near_duplicates(docs, radius=4):
    """docs: (doc_id, text); returns sorted (doc_id, print, component)."""
    prints = [(doc_id, simhash(text)) for doc_id, text in docs]
    roots = components([one for _, one in prints], radius)
    least = defaultdict(list)
    for doc_id, one in prints:
        if doc_id is not None:
            least[roots[one]].append(doc_id)
    return [(d, one, min(least[roots[one]], default=None)) for d, one in prints]


def contamination(docs, items, size=10):
    """Return (doc_id, n_words, n_hit, item ids) by looking for every window everywhere."""
    windows = defaultdict(set)
    for item_id, text in items:
        words = tuple(TEST_WORD.findall((text or "").translate(LOWER)))
        for at in range(max(1, len(words) - size + 1) if words else 0):
            windows[words[at : at + size]].add(item_id)
    sizes = {len(window) for window in windows}
    out = []
    for doc_id, text in docs:
        words = tuple(TEST_WORD.findall((text or "").translate(LOWER)))
        hit, found = set(), set()
        for length in sizes:
            for at in range(len(words) - length + 1):
                if words[at : at + length] in windows:
                    hit.update(range(at, at + length))
                    found |= windows[words[at : at + length]]
        names = sorted({str(item) for item in found if item is not None})
        out.append((doc_id, len(words), len(hit), len(names), sha256(",".join(names)), bool(hit)))
    return out


def chat(rows):
    """rows: (conv_id, turn, role, text), no nulls in turn; returns the digests per conversation."""
    out = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out[conv] = (len(turns), sha256(said), len(loss), sha256(loss))
    return out


def token_ids(name, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    done = tokenizer.encode_batch([text or "" for text in texts], add_special_tokens=False)
    return [[*one.ids, end] for one in done]


def crc_of(ids):
    return zlib.crc32(b"".join(one.to_bytes(4, "little") for one in ids))


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for at in range(len(words) - 4):
        windows[tuple(words[at : at + 5])].append(at)
    repeated = {
        at + k for places in windows.values() if len(places) > 1 for at in places for k in range(5)
    }
    lines = text.split("\n")
    dups = sum(bool(WORD.search(line)) and line in lines[:at] for at, line in enumerate(lines))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, dups, len(repeated), failed)


def rules(docs, share=0.1, least=20, kept_percent=50):
    """docs: (doc_id, host, text); returns sorted rows of counts and verdict."""

    def line_words(line):
        return tuple(WORD.findall(line.translate(LOWER)))

    on, pages = defaultdict(set), defaultdict(set)
    for _, host, text in docs:
        pages[host].add(text or "")
        for line in (text or "").split("\n"):
            if line_words(line):
                on[host, line_words(line)].add(text)
    out = []
    for doc_id, host, text in docs:
        base = base_counts(text)
        gone = 0
        for line in (text or "").split("\n"):
            words = line_words(line)
            n = len(on[host, words]) if words else 0
            if n > least and n > share * len(pages[host]):
                gone += len(words)
        left = base[0] - gone
        depleted = left < 10 or 100 * left < kept_percent * base[0]
        out.append((doc_id, *base[:5], gone, base[5], not (base[5] or depleted)))
    return out


def secrets(text):
    """Return (start, rank, end) of all base kinds."""
    rules = (
        (r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    return sorted(
        (match.start(), rank, match.end())
        for rank, (pattern, group, least) in enumerate(rules)
        for match in re.finditer(pattern, text or "")
        if len(match.group(group)) >= least
    )


def repeats(docs, size=50):
    """Return (doc_id, n_words, n_removed, digest of the kept words)."""
    least = {}
    split = [(doc_id, WORD.findall(text or "")) for doc_id, text in docs]
    for doc_id, words in split:
        if doc_id is not None:
            for at in range(len(words) - size + 1):
                key = tuple(words[at : at + size])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, words in split:
        gone = set()
        if doc_id is not None:
            for at in range(len(words) - size + 1):
                if least[tuple(words[at : at + size])] < doc_id:
                    gone.update(range(at, at + size))
        kept = [word for at, word in enumerate(words) if at not in gone]
        out.append((doc_id, len(words), len(gone), sha256(" ".join(kept))))
    return out


def line_dedup(docs, ratio=0.1, least=5):
    """docs: (doc_id, host, text); returns (doc_id, n_lines, n_dropped, text)."""
    on, pages = defaultdict(int), defaultdict(int)
    for _, host, text in docs:
        pages[host] += 1
        for key in {line.strip(" \t\n\x0b\x0c\r") for line in (text or "").split("\n")} - {""}:
            on[host, key] += 1
    out = []
    for doc_id, host, text in docs:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = []
        for line in lines:
            n = on[host, line.strip(" \t\n\x0b\x0c\r")]
            if not (line.strip(" \t\n\x0b\x0c\r") and n >= least and n > ratio * pages[host]):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def jaccard_sets(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[at : at + size]) for at in range(max(1, len(words) - size + 1)) if words}


def jaccard_classes(docs, percent, size, empty_linked=False):
    """docs: (doc_id, text); returns the class of each row by comparing all pairs of sets."""
    sets = [jaccard_sets(text, size) for _, text in docs]
    root = list(range(len(docs)))
    for at, left in enumerate(sets):
        for other in range(at):
            right = sets[other]
            near = 100 * len(left & right) >= percent * len(left | right)
            if root[at] != root[other] and near and (empty_linked or (left and right)):
                low, high = sorted((root[at], root[other]))
                root = [low if one == high else one for one in root]
    return root


def jaccard_join(docs, percent=85, size=4):
    """docs: (doc_id, text); returns (doc_id, n_shingles, component_id)."""
    roots, ids = jaccard_classes(docs, percent, size), defaultdict(list)
    for (doc_id, _), root in zip(docs, roots, strict=True):
        if doc_id is not None:
            ids[root].append(doc_id)
    return [
        (doc_id, len(jaccard_sets(text, size)), min(ids[root], default=None))
        for (doc_id, text), root in zip(docs, roots, strict=True)
    ]


def usable(vector):
    return vector is not None and len(vector) > 0 and all(
        c is not None and math.isfinite(c) for c in vector
    )


def whitened(rows, most=8):
    """rows: (vec_id, vector); returns each row's deviation and the exact and whitened parts."""
    kept = [(key, [math.floor(1024 * c) + 100_000 for c in v]) for key, v in rows if usable(v)]
    n = len(kept)
    sums = [sum(column) for column in zip(*(x for _, x in kept), strict=True)]
    x = np.array([[a - s / n for a, s in zip(one, sums)] for _, one in kept])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    order = np.argsort(-values)[:most]
    scores = x @ vectors[:, order] / np.sqrt(values[order])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(one, sums)) for _, one in kept]
    return [key for key, _ in kept], deviations, scores, values[order] / values.sum()


def hard_negatives(rows, anchors=100):
    """rows: (vec_id, vector, label); returns sorted rows for the ids divisible by ``anchors``."""
    points = [
        (key, [math.floor(256 * c) for c in v], label)
        for key, v, label in rows
        if usable(v) and label is not None and key is not None
    ]
    out = set()
    for key, vector, label in points:
        if key % anchors:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, v, strict=True)), k, own)
            for k, v, own in points
            if k != key
        )
        for positive, name, _ in [one for one in scored if one[2] == label][:5]:
            fits = [
                (-s, k) for s, k, own in scored
                if own != label and 80 * -positive <= 100 * -s <= 100 * -positive
            ][:5]
            out |= {(key, name, at + 1, k, -positive, s) for at, (s, k) in enumerate(fits)}
    return sorted(out)


def without_contamination(docs, items, size=10):
    """docs: (doc_id, text); returns each text less the spans that occur in an item."""
    windows = set()
    for _, text in items:
        words = tuple(TEST_WORD.findall((text or "").translate(LOWER)))
        windows |= {words[at : at + size] for at in range(max(1, len(words) - size + 1)) if words}
    out = []
    for doc_id, text in docs:
        places = [m.span() for m in TEST_WORD.finditer(text.translate(LOWER))]
        words = tuple(text.translate(LOWER)[a:b] for a, b in places)
        hit = set()
        for length in {len(window) for window in windows}:
            for at in range(len(words) - length + 1):
                if words[at : at + length] in windows:
                    hit.update(range(at, at + length))
        gone = {k for at in hit for k in range(*places[at])}
        gone |= {k for at in hit if at + 1 in hit for k in range(places[at][1], places[at + 1][0])}
        left = "".join(c for at, c in enumerate(text) if at not in gone)
        out.append((doc_id, left, bool(hit)))
    return out
