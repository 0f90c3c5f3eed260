"""Many damaged members are salvaged in linear time."""

import gzip
import time

from lodestone.llm import warc


def archive(n, damaged):
    out, good = [], 0
    for k in range(n):
        body = f"<p>page {k}</p>".encode() * 9
        member = bytearray(gzip.compress(warc.record("response", k, f"http://h/{k}", body, __import__("hashlib").sha256(body).hexdigest(), None), 6, mtime=0))
        if damaged(k):
            member[len(member) // 2] ^= 0xFF
            member[-3] ^= 0xFF
        else:
            good += 1
        out.append(bytes(member))
    return b"".join(out), good


def test_damaged_members_take_linear_time():
    def took(n):
        data, good = archive(n, lambda k: k % 10 > 0)
        began = time.process_time()
        found = list(warc.salvage(data))
        assert sum(r[2] is not None for r in found) == good
        assert sum(r[1] for r in found) == len(data)
        return time.process_time() - began

    assert took(20_000) < 20 * max(took(2_000), 0.02)
