"""Secret scan: three fixed patterns, and literals that source or configuration syntax assigns to sensitive names.

The lexer walks over a text's assignments: ``name = value``, ``name: value``, ``"name": value``, ``name => value``,
``NAME=value``, ``<name>value<``, ``-D name=value``. A value is a chain of quoted strings and names joined by ``+`` or ``.``, or
one bare word; strings have any length, and those in back quotes, three quotes or without an end on their line go over lines. A string may
have a prefix (``f"..."``), stand on the next line, or follow another in brackets; a YAML block under a sensitive name is a chain of its
lines. A name followed by ``(`` is a call and no value. Literals inside the brackets of a sensitive name's value (a container or a call) are
that name's, as are the second of a call's two leading strings for the first (``define("NAME", "...")``) and a tag's ``value`` for its ``key``
or ``name``; of those in brackets only literals that look like secrets (INSIDE) count. Leading
dashes of a name and a type between name and ``=`` are skipped; strings are searched for assignments too. Names that were given a literal are
constants of that text, wherever they are given it; a name whose value is another name takes that name's literals, so
``k = "..."; client_secret = k`` scores the literal at the first place for the second name. The joined value of a chain and each of its
parts get a score for the name: what the name says (FULL, HALF, LESS below), less where the literal looks like a placeholder,
a word or a path, more where its letters are many and mixed. A score of THRESHOLD or more is a find."""

import math
import re
from collections import Counter

# The three base patterns of the contract. A failing match uses up its characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# Parts of names and what they weigh.
FULL = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "signingkey",
        "encryptionkey", "masterkey", "clientsecret", "authtoken", "bearer", "credential", "credentials", "connectionstring", "connstr")
HALF = ("auth", "authorization", "key", "cred", "creds", "pass", "salt", "signature", "session", "cookie", "jwt", "dsn", "pin", "otp", "hmac")
LESS = ("public", "count", "length", "limit", "max", "min", "size", "name", "type", "path", "file", "url", "id", "index", "expiry", "ttl", "hint", "field", "label", "policy")
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|changeme|example.*|your.*|none|null|nil|true|false|undefined|todo|test|dummy|placeholder|redacted|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\)s|\{\{.*\}\})$")
THRESHOLD = 1.0
INSIDE = 0.5  # what a literal inside brackets must weigh by itself
LITERAL_LEAST = 6

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])-*({NAME})(?:["'\]]\]?)?[\x20\t]*(:=|=>|=(?!=)|:(?!:)|>)[\x20\t]*(?:\\?\r?\n[\x20\t]*(?=[fFbBrRuU]{{0,2}}["'`]))?""", re.ASCII)
TYPE = re.compile(r"""(?:&'[a-z]+\x20)?[A-Za-z_&*\[](?:[A-Za-z0-9_.&*|?!\]\x20]|\[[^\]\n"'`=:]*+\]|<[^\n"'`=:;>]*+>+)*+(?:(?<=\x20)=|=(?=\x20*["'`]))(?![=>])\x20*""", re.ASCII)
TRIPLE = r"""\"{3}(?s:.)*?\"{3}|'{3}(?s:.)*?'{3}"""
LINE = r"""\"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"""
LINES = r"""\"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+\"|'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+'|`[^`]*+`"""
PREFIX = r"""(?:[fFbBrRuU]{1,2}(?=["']))?"""
PART = re.compile(rf"""{PREFIX}(?:({TRIPLE})|({LINE}|{LINES}))|({NAME})(?![A-Za-z0-9+/=_$\-])""", re.ASCII)
OPEN = re.compile(rf"""(?:new\x20+)?(?:{NAME})?[\x20\t]*([(\[{{])""", re.ASCII)
TOKEN = re.compile(rf"""({TRIPLE})|({LINE})|([(\[{{])|([)\]}}])""")
CALL = re.compile(rf"""\([\x20\t]*["']({NAME})["'][\x20\t]*,[\x20\t]*(?=[fFbBrRuU]{{0,2}}["'`])""", re.ASCII)
KEYED = re.compile(rf"""(?i:\b(?:key|name))[\x20\t]*=[\x20\t]*["']({NAME})["']\s+(?i:value)[\x20\t]*=[\x20\t]*(?=["'])""", re.ASCII)
VALUED = re.compile(rf"""(?i:\bvalue)[\x20\t]*=[\x20\t]*({LINE})\s+(?i:key|name)[\x20\t]*=[\x20\t]*["']({NAME})["']""", re.ASCII)
BLOCK = re.compile(r"[|>][+\-0-9]*[\x20\t]*\r?\n")
BLOCK_LINE = re.compile(r"([\x20\t]*)([^\n]*)(?:\n|\Z)")
BARE = re.compile(r"[A-Za-z0-9+/_.=$!@#%^&*~\-]+", re.ASCII)
BREAK = r"(?:\\?\r?\n[\x20\t]*)?"
JOIN = re.compile(rf"[\x20\t]*{BREAK}(?:\+|\.\.)[\x20\t]*{BREAK}", re.ASCII)
NEXT = re.compile(rf"""[\x20\t]*{BREAK}(?=[fFbBrRuU]{{0,2}}["'])""", re.ASCII)
HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


def name_weight(name: str) -> float:
    """2 for a name that says secret, 1 for one that hints at it, 0 for others; halved by parts that say it is about one."""
    parts = [p.lower() for p in HUMP.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])} | set(parts)
    weight = 2.0 if joined & set(FULL) else 1.0 if joined & set(HALF) else 0.0
    return weight / 2 if weight and set(parts[-1:]) & set(LESS) or parts[:1] == ["public"] else weight


def literal_weight(value: str) -> float:
    """0 to 1 by length, kinds of characters and entropy; -2 for a placeholder."""
    if PLACEHOLDER.match(value):
        return -2.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    if re.search(r"\s", value) or kinds < 2:
        return 0.0
    return min(1.0, n / 32 + max(0.0, bits - 2) / 4 + (kinds - 2) / 4)


def block_lines(text: str, key: int, at: int, end: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the lines of a YAML block that begins at ``at`` under the key at ``key``, and where it ends."""
    indent, out = key - text.rfind("\n", 0, key) - 1, []
    while at < end and (m := BLOCK_LINE.match(text, at, end)) and m.end() > at and (not m[2].strip() or len(m[1]) > indent):
        if m[2].strip():
            out.append((m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return out, at


def assignments(text: str) -> tuple[list[tuple[int, str, list, tuple[int, int] | None]], dict[int, str]]:
    """Place and name of each assignment, the spans and names of its chain, and a bare word to take where no literal is reached; and the
    brackets that open the value of a sensitive name, with it."""
    out, regions, seen, opens = [], [(0, len(text))], set(), {}
    while regions:
        at, end = regions.pop()
        while m := PAIR.search(text, at, end):
            typed = TYPE.match(text, m.end(), end) if m[2] == ":" else None
            at, where, parts, bare = m.end(), (typed or m).end(), [], None
            if m[2] == ":" and (b := BLOCK.match(text, where, end)) and name_weight(m[1]):
                lines, at = block_lines(text, m.start(1), b.end(), end)
                if lines:
                    out.append((m.start(), m[1], lines, None))
                continue
            if (o := OPEN.match(text, where, end)) and name_weight(m[1]):
                opens[o.start(1)] = m[1]
            bracket = bool(o) and o.end() == where + 1
            if bracket:
                where += len(text[where:where + 1])
                where = NEXT.match(text, where, end).end() if NEXT.match(text, where, end) else where
            elif o:
                continue  # a call
            first = where
            while p := PART.match(text, where, end):
                if p[3] is not None and bracket:
                    break
                width, of = (3, 1) if p[1] is not None else (1, 2)
                parts.append(p[3] if p[3] is not None else (p.start(of) + width, p.end() - width))
                where = p.end()
                j = JOIN.match(text, where, end) or (p[3] is None and (bracket or text[where:where + 1] in (" ", "\t", '"', "'")) and NEXT.match(text, where, end))
                if not j:
                    break
                where = j.end()
            inner = [p for p in parts if not isinstance(p, str)]
            if not inner and not bracket and (b := BARE.match(text, first, end)) and not PAIR.match(text, first, end) and not text.startswith("(", b.end()):
                bare = b.span()
            if parts or bare:
                out.append((m.start(), m[1], parts, bare))
            if not typed and (inner or bare):
                at = max(at, where if inner else bare[1])
            regions += [p for p in inner if p not in seen]
            seen.update(inner)
    return sorted(out, key=lambda x: x[0]), opens


def bracketed(text: str, opens: dict[int, str]) -> list[tuple[str, tuple[int, int]]]:
    """The strings inside closed brackets of ``opens``, each with the name of the innermost."""
    out, stack = [], []  # of open brackets: the name, its strings so far, and whether it is the name's own bracket
    for m in TOKEN.finditer(text) if opens else ():
        if m[3]:
            name = opens.get(m.start())
            stack.append((name, [], True) if name else (*stack[-1][:2], False) if stack else (None, None, False))
        elif m[4]:
            if stack:
                name, held, own = stack.pop()
                if own:
                    out += [(name, x) for x in held]
        elif stack and stack[-1][0]:
            width = 3 if m[1] else 1
            stack[-1][1].append((m.start() + width, m.end() - width))
    return out


def named_pairs(text: str) -> list[tuple[str, tuple[int, int]]]:
    """Name-literal pairs of calls with two leading strings, and of a tag's attributes."""
    out = []
    for pattern in (CALL, KEYED) if "(" in text or "=" in text else ():
        for m in pattern.finditer(text):
            if name_weight(m[1]) and (p := PART.match(text, m.end())) and p[3] is None:
                width, of = (3, 1) if p[1] is not None else (1, 2)
                out.append((m[1], (p.start(of) + width, p.end() - width)))
    return out + [(m[2], (m.start(1) + 1, m.end(1) - 1)) for m in VALUED.finditer(text)]


def pairs(given: list) -> list[tuple[str, list[tuple[int, int]]]]:
    """Names and the spans of the literals they are given, constants followed within the text: first those given before, then, from the
    end and once more from the start, those given after their use."""
    known: dict[str, list] = {}
    out: list = [None] * len(given)
    ahead = []  # names not known before their use

    def settle(i: int) -> None:
        _, name, parts, bare = given[i]
        spans = [s for p in parts for s in (known.get(p, []) if isinstance(p, str) else [p])]
        spans = list(dict.fromkeys(spans)) or ([bare] if bare else [])
        if spans:
            out[i] = (name, spans)
            known[name] = spans

    for i, (_, _, parts, _) in enumerate(given):
        ahead.append({p for p in parts if isinstance(p, str) and p not in known})
        settle(i)
    later = [i for i, names in enumerate(ahead) if names & known.keys()]
    for i in later[::-1] + later:
        settle(i)
    return [x for x in out if x]


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that score THRESHOLD or more for a name they reach, alone or joined with the others of their chain."""
    found = set()
    if not (":" in text or "=" in text or ">" in text or "(" in text):
        return []
    given, opens = assignments(text)
    for name, spans in pairs(given) + [(name, [span]) for name, span in named_pairs(text)]:
        weight = name_weight(name)
        if weight:
            def enough(value):
                return len(value) >= LITERAL_LEAST and weight / 2 + literal_weight(value) >= THRESHOLD + (weight < 2) * 0.5

            if len(spans) > 1 and enough("".join(text[s:e] for s, e in spans)):
                found.update(x for x in spans if x[0] < x[1])
            found.update((s, e) for s, e in spans if enough(text[s:e]))
    for name, (start, end) in bracketed(text, opens):
        value = text[start:end]
        weight = literal_weight(value) if end - start >= LITERAL_LEAST and re.search("[0-9]", value) else 0  # without a digit it may be a name
        if weight >= INSIDE and name_weight(name) / 2 + weight >= THRESHOLD + (name_weight(name) < 2) * 0.5:
            found.add((start, end))
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, each leftmost and without overlap of its kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST] if ":" in text or "=" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + [(s, 3, e) for s, e in literals(text)])


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
