"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE = r"\x20\x09-\x0D"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def secrets(t, added=False):
    out = []
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
        ("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1),
        ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
        ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ][: 7 if added else 3]
    for k, (kind, p, g, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t or "") if len(m[g]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def licenses(t):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    at, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def personal_spans(t):
    """[(kind, start, end, match)] by kind, then start."""
    digits = lambda s: sum(c.isdigit() for c in s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= digits(s) <= 15),
    ]
    return [(k, m.start(), m.end(), m[0]) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


def personal(t):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in personal_spans(t))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def words_outside(t):
    """(start, end, lower-cased) of runs of three letters and more, with emails blanked."""
    blank = re.sub(EMAIL, lambda m: " " * len(m[0]), t or "")
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", blank)]


def entities(t):
    out = set()
    for kind, _, _, m in personal_spans(t):
        m = m.lower()
        digits = re.sub("[^0-9]", "", m)
        parts = m.split(".")
        wider = {"email": [m.split("@")[-1]], "ip": [".".join(parts[:2]), ".".join(parts[:3])]}.get(kind, [digits[:4], digits[:6]])
        out |= {kind, f"{kind}:{m}"} | {f"{kind}~{w}" for w in wider}
    return out


def disclosing(texts, alpha):
    """Terms that give an entity away, by counts over the distinct texts."""
    texts = {t or "" for t in texts}
    n, terms = len(texts), {t: {w for _, _, w in words_outside(t)} for t in texts}
    n_term, n_entity, both = Counter(), Counter(), Counter()
    for t in texts:
        n_term.update(terms[t])
        n_entity.update(entities(t))
        both.update((e, w) for e in entities(t) for w in terms[t])
    out = set()
    for (e, w), b in both.items():
        p = n_entity[e] / n
        if b > 1 and p < 1 and math.log2((b - 1 + p) / n_term[w] / p) >= -alpha * math.log2(p):
            out.add(w)
    return out


def all_personal(texts, alpha=0.8):
    """{id: all spans of op8}. texts: {id: text}."""
    telling = disclosing(texts.values(), alpha)
    return {i: ",".join(filter(None, [personal(t), *(f"term:{a}:{b}" for a, b, w in words_outside(t) if w in telling)])) for i, t in texts.items()}


def sanitised(t, spans):
    out, at, upto = "", 0, 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], ["email", "ip", "card", "phone", "term"].index(s[0]), s[2])):
        if a >= upto:
            out, at = out + t[at:a] + f"[{kind.upper()}]", b
        at = upto = max(upto, b)
    return out + t[at:]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def measures(t):
    t = t or ""
    w = re.findall(f"[^{SPACE}]+", t)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if re.search(f"[^{SPACE}]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def fingerprint(t):
    w = re.findall(f"[^{SPACE}]+", lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, threshold=2):
    """Least reachable id for each id. prints: {id: fingerprint}."""
    left, out = set(prints), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (prints[x] ^ prints[y]).bit_count() <= threshold}
            left -= near
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def lines(t):
    """A text's lines with what ends them: up to \\n, or up to a mark and a space once there are 40 characters."""
    out, now = [], ""
    for c in t:
        now += c
        if c == "\n" or c == " " and now[-2:-1] in tuple(".!?,;:") and len(now) >= 42:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def lines_left(docs):
    """{key: text} after later occurrences of three-line windows go. docs: {key: text}, in order of key."""
    seen, out = set(), {}
    for i in sorted(docs):
        if docs[i] is None:
            out[i] = None
            continue
        raw, gone = lines(docs[i]), set()
        ls = [x.rstrip(" \n") for x in raw]
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not re.search(r"\S", "".join(w)):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = "".join(x for k, x in enumerate(raw) if k not in gone)
    return out


def shingles(t, width=5):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def contained(docs, items, width=5, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    out = set()
    for i, s in ((i, shingles(t)) for i, t in items.items()):
        for d, text in docs.items():
            shared = len(s & shingles(text))
            if s and shared >= threshold * len(s) - 1e-9:
                out.add((d, i, len(s), shared))
    return out
