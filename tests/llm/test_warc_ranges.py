import io
import random

import pytest

from echolens.llm import warc


class Counted:
    """A file that counts what is read of it."""
    def __init__(self, content):
        self.content, self.calls, self.n_bytes = content, 0, 0

    def read_at(self, n, start):
        self.calls += 1
        self.n_bytes += n
        return self.content[start:start + n]


def archive(n, seed=1):
    """An archive with payloads of very different sizes, and the places of its records."""
    rng, content, places = random.Random(seed), b"", []
    for i in range(n):
        payload = rng.randbytes(rng.choice([0, 5, 3000, 400_000 if i % 10 == 0 else 50]))
        member = warc.record(i, f"http://ex.org/{i}", payload, warc.base32_sha1(payload), i)
        places.append((len(content), len(member)))
        content += member + warc.PADDING.encode()
    return content, places


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_members_in_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    content, places = archive(30 if piece > 1 else 4)
    found = list(warc.members(io.BytesIO(content)))
    assert [(o, n) for o, n, _ in found] == places
    assert [h["warc-target-uri"] for *_, h in found] == [f"http://ex.org/{i}" for i in range(len(places))]
    assert list(warc.members(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(content[:-20])))


def test_only_the_wanted_ranges_are_read(monkeypatch):
    content, places = archive(60)
    file = Counted(content)
    wanted = [places[i] for i in (3, 17, 18, 19, 55)]
    assert list(warc.read_ranges(file, wanted)) == [content[o:o + n] for o, n in wanted]
    # three neighbours are one read, with the padding between them
    assert file.calls == 3 and file.n_bytes == sum(n for _, n in wanted) + 2
    file = Counted(content)
    assert list(warc.read_ranges(file, places)) == [content[o:o + n] for o, n in places]
    assert file.calls == 1
    monkeypatch.setattr(warc, "READ_AT_ONCE", len(content) // 3)
    file = Counted(content)
    assert list(warc.read_ranges(file, places)) == [content[o:o + n] for o, n in places]
    assert file.calls >= 3
    assert list(warc.read_ranges(file, [])) == []


def test_paths_as_spark_spells_them():
    fs, name = warc._place("file:/tmp/a b/part-0.txt")
    assert fs.type_name == "local" and name == "/tmp/a b/part-0.txt"
    assert warc._place("file:///tmp/x")[1] == "/tmp/x"
