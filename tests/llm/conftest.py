import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, kept int, spans string, label string, node string"
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    own = random.Random(seed)
    words = [own.choice(VOCAB) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, n, 12))


def near(text, seed):
    words = text.split(" ")
    words[seed % len(words)] = "changed"
    return " ".join(words)


def hard_texts():
    base = [prose(120, s) for s in range(6)]
    return [
        None,
        "",
        "",
        " ",
        "\n",
        "a",
        "  two  spaces\tand\n\n tabs \n",
        "\x00 odd \x01 marks \x1c here",
        "İstanbul ΣΑΣ é été 日本語 🎉🎉 ok​",
        "<|endoftext|> don't I'LL we've",
        "x" * 3000,
        prose(20000, 99),
        *base,
        base[0].upper(),
        base[0],
        near(base[1], 3),
        near(base[1], 50),
        near(base[2], 7),
        "Mail a.b@mail.example.com or c%d@e.f%g@h.i now; ip 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 and 12345678901234567890; call +1 (603) 555-4275, +44 20 +1",
        "phone: +1 (603) 555-4275) mail x@y.z@w.v ssn 123-45-6789 Dr. John Smith 79927398713",
        "The MIT License and GNU General Public License; cc by cc by-sa apache license.\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0",
        "spdx-license-identifier: MIT OR",
    ]


@pytest.fixture(scope="session")
def rows():
    texts = hard_texts()
    out = [(k * 7 % 1000, t, "en", "s", None, "d", 1, 0, "x", "l", "n") for k, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Every id once."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark, rows):
    """Rows repeated, and rows without an id."""
    more = [*rows, rows[13], rows[13], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
