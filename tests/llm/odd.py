"""Rows that the tests of this folder share."""


def words(n, start=0, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(start, start + n))


#: nulls, blanks, a long text, repeated rows and ids, as every operator must bear them
ODD = [
    (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (4, "x"), (4, "y"), (None, "x"), (5, words(60)), (5, words(60)),
    (6, words(60, mark="ü▁")), (7, "a" * 5000), (8, words(20000, mark="l") + "\n" * 50), (9, "\\<|im_end|>\x0b\x0c"),
]
