"""Plain-Python restatements of the sequential rules, used only to check the Spark operators."""


def windows(content, window=1200, overlap=200):
    """(text, start line, end line) of sliding windows over str or bytes."""
    newline = b"\n" if isinstance(content, bytes) else "\n"
    out, at, line = [], 0, 1
    while at < len(content):
        stop = min(at + window, len(content))
        piece = content[at:stop]
        last = line + piece.count(newline)
        out.append((piece, line, last))
        if stop == len(content):
            return out
        at, line = at + window - overlap, last
    return out


def split_lines(lines, target, overlap=3):
    """[first, end) runs of a too-long symbol."""
    runs, at = [], 0
    while at < len(lines):
        size, end = 0, at
        while end < len(lines) and size + len(lines[end]) <= target:
            size += len(lines[end]) + 1
            end += 1
        end = max(end, at + 1)
        runs.append((at, end))
        at = end - overlap if end - overlap > at else end
    return runs


def admitted(times, limit, width):
    """Admission of ordered failures, with the recorded times kept in full."""
    recorded, out = [], []
    for t in times:
        fresh = [r for r in recorded if r > t - width]
        out.append(len(fresh) < limit)
        recorded = fresh + [t] if len(fresh) < limit else fresh
    return out
