"""The bit-sliced comparison stops reading words whose lanes have all overflowed."""

import numpy as np

from pagemill.llm import simhash


def test_later_planes_are_not_read():
    fps = np.random.default_rng(1).integers(0, 1 << 63, 512, dtype=np.uint64)
    read = []

    class Planes(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, int):
                read.append(at)
            return np.asarray(self)[at].view(Planes) if isinstance(at, tuple) else np.asarray(self)[at]

    plain = simhash.planes
    simhash.planes = lambda x: plain(x).view(Planes)
    try:
        moved, _ = simhash.bucket_links(fps, 2)
    finally:
        simhash.planes = plain
    assert not len(moved) and max(read) < 63
