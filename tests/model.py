"""The network's definition as plain loops, for tests."""

import math
from collections import Counter


def network(sentences, window, decay=lambda d: math.exp(-d)):
    """sentences: {doc: [(entities, terms), ...]} with entities as (norm, label) and terms as strings, in order.

    Returns (edges {(a, b): (weight, count)}, entity_terms {(a, term): n}, entity counts).
    """
    instances, pairs, counts = {}, Counter(), Counter()
    for doc in sentences.values():
        mentions = [(i, e) for i, (entities, _) in enumerate(doc) for e in entities]
        counts.update(e for _, e in mentions)
        for x, (i, a) in enumerate(mentions):
            for j, b in mentions[x + 1 :]:
                if a != b and j - i <= window:
                    instances.setdefault(tuple(sorted((a, b))), []).append(j - i)
        for entities, terms in doc:
            pairs.update((e, t) for e in entities for t in terms)
    return {k: (sum(decay(d) for d in v), len(v)) for k, v in instances.items()}, pairs, counts


def loads(edges, counts):
    """{(a, b): weight} of the directed importance."""
    sizes = Counter(label for _, label in counts)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for a, others in near.items():
        for b in others:
            degree = sum(1 for o in others if o[1] == b[1])
            if sizes[b[1]] != degree:
                out[a, b] = math.log(sizes[b[1]] / degree) * edges[tuple(sorted((a, b)))][0]
    return out
