"""Plain Python forms of the operators, for comparison."""

import hashlib
import re


def decontaminate(docs, items, window=13):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = low(text)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[s : s + window]), set()).update({str(item)} - {'None'})
    lengths = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w, hit, found = low(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def pii(text):
    out = []
    for place, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), place, kind, m.end()))
    out.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in out)
    return [sum(x[2] == k for x in out) for k in PII], hashlib.sha256(joined.encode()).hexdigest(), joined


def shingle_sets(docs, k=4):
    out = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def jaccard_components(docs, k=4, percent=85):
    sets, root = shingle_sets(docs, k), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)]
