"""Plain loops that several tests compare with."""


def tokens(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        raw = raw.replace(c, " ")
    return [w for w in raw.split(" ") if w]


def word_count(text):
    return len(tokens(text))


def near_groups(rows, words, percent=80):
    """{doc_id: smallest doc_id reachable} by comparing all pairs; ids must differ."""
    sets = []
    for _, text in rows:
        t = tokens(text)
        sets.append({tuple(t)} if 0 < len(t) < words else {tuple(t[i:i + words]) for i in range(len(t) - words + 1)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return {doc_id: low[find(i)] for i, (doc_id, _) in enumerate(rows)}

