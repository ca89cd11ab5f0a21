"""A graph of 15 vertices and 27 edges whose answers are known, in all text formats."""

EDGES = [tuple(map(int, e.split("-"))) for e in "1-2 1-4 1-5 2-3 2-5 3-4 3-5 3-13 4-5 4-9 6-7 6-9 6-10 7-8 7-10 7-11 8-9 8-10 9-10 11-12 11-14 11-15 12-13 12-15 13-14 13-15 14-15".split()]
LABELS = dict(enumerate("acbcbdadbdabdbc", 1))
TRIANGLES = {(1, 2, 5), (1, 4, 5), (2, 3, 5), (3, 4, 5), (6, 7, 10), (6, 9, 10), (7, 8, 10), (8, 9, 10), (11, 12, 15), (11, 14, 15), (12, 13, 15), (13, 14, 15)}
MATCHES = {(1, 5, 2, 3, 13), (1, 5, 4, 3, 13), (1, 5, 4, 9, 6), (1, 5, 4, 9, 8), (1, 5, 4, 9, 10), (11, 12, 15, 14, 13), (11, 14, 15, 12, 13)}


def neighbours():
    out = {v: [] for v in LABELS}
    for a, b in EDGES:
        out[a].append(b)
        out[b].append(a)
    return {v: sorted(n) for v, n in out.items()}


def raw_lines(kind):
    lines = []
    for v, near in neighbours().items():
        if kind == "normal":
            lines.append(f"{v}\t{len(near)} " + " ".join(map(str, near)))
        elif kind == "label":
            lines.append(f"{v} {LABELS[v]}\t" + " ".join(f"{n} {LABELS[n]}" for n in near))
        elif kind == "attr":
            lines.append(f"{v}\tX{v % 3} Y{v % 2}\t{len(near)} " + " ".join(map(str, near)))
        else:
            lines.append(f"{v}\tX{v % 3}\t{len(near)} " + " ".join(f"{n} {(v + n) % 7 / 8}" for n in near))
    return lines
