"""Plain, slow versions of the operators, for comparison."""

import math
import re
from collections import Counter, defaultdict


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def linked(a, b, percent=75):
    both = len(a & b)
    return bool(a) and 100 * both >= percent * (len(a) + len(b) - both)


def near_components(texts, percent=75):
    """{doc_id: (n_shingles, component)}, by comparing all sets that share one of their rarest shingles."""
    sets = {doc: shingle_set(text) for doc, text in texts.items()}
    first = {}
    parent = {doc: doc for doc in sets}

    def root(doc):
        while parent[doc] != doc:
            parent[doc] = doc = parent[parent[doc]]
        return doc

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for doc in sorted(sets):
        if sets[doc]:
            join(doc, first.setdefault(sets[doc], doc))
    counts = Counter(s for shingles in first for s in shingles)
    index = defaultdict(list)
    for shingles in sorted(first, key=len):
        rare = sorted(shingles, key=lambda s: (counts[s], s))
        rare = rare[: len(rare) - math.ceil(percent / 100 * len(rare)) + 1]
        for other in {o for s in rare for o in index[s]}:
            if linked(shingles, other, percent):
                join(first[shingles], first[other])
        for s in rare:
            index[s].append(shingles)
    return {doc: (len(sets[doc]), root(doc)) for doc in sets}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text):
    """(words, sorted places of the phrases, their labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        places += found
        labels |= {label} if found else set()
    return len(words), sorted(places), labels
