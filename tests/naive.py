"""Everything by sorted suffixes, for comparison."""


def suffix_array(text: bytes) -> list[int]:
    return sorted(range(len(text)), key=lambda k: text[k:])


def bwt(text: bytes) -> bytes:
    return bytes(text[k - 1] for k in suffix_array(text))


def occurrences(text: bytes, pattern: bytes) -> list[int]:
    """In suffix-array order."""
    return [k for k in suffix_array(text) if text.startswith(pattern, k)]


def runs(symbols: bytes) -> list[tuple[int, int, int]]:
    out = []
    for i, c in enumerate(symbols):
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1, out[-1][2])
        else:
            out.append((c, 1, i))
    return out
