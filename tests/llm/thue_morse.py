"""Different texts on which every polynomial modulo 2**64 agrees."""


def pair(bits: int) -> tuple[str, str]:
    word = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))
