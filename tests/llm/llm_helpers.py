"""Edge-case rows and word splitting of the contracts."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))

#: Null and empty texts, white space only, repeated rows, a null id, a very long text, extra columns
#: with names that the operators use themselves.
ROWS = [
    (1, None, "en", "k1"), (2, "", "en", "k2"), (3, " \t\n", "en", None), (4, "a b c d e f g h", "en", "x"),
    (4, "a b c d e f g h", "en", "x"), (None, "a b c d e f g h", "en", "y"), (5, LONG, "de", "z"),
    (6, "One line here\nOne line here\nother line\nOne line here", "en", "z"),
]
SCHEMA = "doc_id long, text string, n long, key string"


def words(text):
    return WORD.findall((text or "").translate(LOW))
