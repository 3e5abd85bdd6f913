import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=4):
    found = words(lower(text or ""))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def near_components(rows, size=4):
    """doc_id -> (number of shingles, smallest doc_id reachable), by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def folder(spark):
    return spark.conf.get("spark.checkpoint.dir")
