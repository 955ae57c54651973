"""Plain-Python models on small inputs, written from the operators' definitions."""

from __future__ import annotations

from itertools import takewhile


def fuzzy(s, r) -> bool:
    """X1 in its closed form: no character of the label is missing from the rest of the text."""
    return s is not None and r is not None and len(r) <= len(s) and all(c in s[i:] for i, c in enumerate(r))


def texts_of(data, path=()):
    """(path, text) of all texts in nested lists, in order."""
    for i, x in enumerate(data):
        yield from [((*path, i), x)] if isinstance(x, str) else texts_of(x, (*path, i))


def item(data, path):
    return item(data[path[0]], path[1:]) if path else data


def flat(x) -> str:
    return x if isinstance(x, str) else "".join(map(flat, x))


def map_nested(data, rules):
    """rules: ordered (label, target). (records, descriptions) of nested lists: records are
    (path, {target: value}) of data rows, descriptions (path, text) of headers with data."""
    targets = list(dict.fromkeys(t for _, t in rules))
    hits: dict[tuple, list] = {}
    for path, text in texts_of(data):
        for k, (label, _) in enumerate(rules):
            if len(path) > 1 and fuzzy(text, label):
                hits.setdefault(path[:-1], []).append((k, path))
    heads = {p: min(h) for p, h in hits.items() if len(h) >= min(len(targets), 3)}
    records, told, before = [], [], None
    for head in sorted(heads, key=heads.get):
        *table, at = head
        rows, names = item(data, table), item(data, head)
        place = [[t for label, t in rules if fuzzy(flat(c), label)] for c in names]
        fits = lambda i: len(rows[i]) == len(names) and (*table, i) not in heads
        below = list(takewhile(fits, range(at + 1, len(rows))))
        for i in below:
            got = {p[-1]: flat(c) for p, c in zip(place, rows[i]) if p}
            records.append(((*table, i), {t: got.get(t, "") for t in targets}))
        if below:
            start = before[1] + 1 if before and before[0] == table else 0
            told.append((head, "".join(flat(r) for r in rows[start:at])))
            before = table, below[-1]
    return records, told


def map_tables(tables, rules):
    """The same for tables of rows of cells: ((table, row, record)..., {(table, header): text})."""
    records, told = map_nested(tables, rules)
    return [(*p, r) for p, r in records], dict(told)


def sections(nos: list[str], levels: list[str], first: int = 100):
    """(position, level) of numbered rows; a number below the one before starts the next
    level, and rows past the last level are dropped."""
    valid = [(i, int(n)) for i, n in enumerate(nos) if n is not None and str(n).isdigit()]
    out, level = [], -1
    for (i, n), (_, last) in zip(valid, [(None, first), *valid]):
        level += n < last
        if level >= len(levels):
            break
        out.append((i, levels[level] if level >= 0 else None))
    return out
