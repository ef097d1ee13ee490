"""An adaptive context-mixing range coder for token ids below 65,536, in blocks that each start from the same empty model.

For each id the ids that followed the last two ids (order 2) and the last one (order 1) give a candidate; how often
candidates of that confidence were right, for order 2, order 1 and the candidate's own frequency (order 0), is mixed by
logistic mixing with weights learnt on the way, and what came of candidates of all three confidences together corrects the
mixture, into the probability of a hit. A miss is coded by the adaptive frequencies of ids that were missed (order 0), and
one that was not missed before by 16 even bits. All arithmetic is on integers, so any machine decodes what another has
encoded.

A block is cut into lanes that go side by side, so that each step is a few array operations over all lanes. They learn one
model: candidates after each step, probabilities and frequencies after every 32nd one (and some of the first). The
coder is the range variant of asymmetric numeral systems: a state of 16 to 32 bits for each lane, and one stream of 16-bit
words, of which at each step the lanes that run short take the next in their order. A block holds the crc32 of the rest, the
number of lanes, their states and the stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 1 << 21
LANES = 4096
#: Lanes are as long at least, so that a short block has few
LANE_IDS = 256
BITS = 12
ONE = 1 << BITS
SLOTS = 1 << 18
WHOLE = 1 << 16
MOST_KNOWN = 60_000
EARLY = {1, 2, 3, 4, 6, 8, 12, 16, 24, 48}
_S12, _S16, _S20 = np.uint32(BITS), np.uint32(16), np.uint32(32 - BITS)
_LOW = np.uint32(0xFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash of -2047..2047 to 12 bits by interpolation between fixed points, and stretch as its inverse."""
    points = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4024, 4055, 4079, 4085, 4089, 4092, 4093, 4094, 4095]
    x = np.arange(-2048, 2048)
    i, w = (x >> 7) + 16, x & 127
    squash = np.array([(points[a] * (128 - b) + points[min(a + 1, 32)] * b + 64) >> 7 for a, b in zip(i.tolist(), w.tolist(), strict=True)], np.int64)
    return squash, (np.searchsorted(squash, np.arange(ONE)) - 2048).clip(-2047, 2047)


SQUASH, STRETCH = _tables()
#: Classes of an id's frequency among misses
OFTEN = 4 ** np.arange(7)
_SURE = np.arange(8)
#: By confidence, and 8 more if the candidate was right: the next confidence (above the candidate's 16 bits), and whether it stays
NEXT = (np.concatenate([np.where(_SURE > 1, _SURE >> 1, 1), np.minimum(_SURE + 1, 7)]) << 16).astype(np.uint32)
STAYS = np.concatenate([_SURE > 1, _SURE >= 0]).astype(np.uint32)


def at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """table[places], which are all inside of it."""
    return table.take(places, mode="wrap")


def either(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where `which`, else b, without a branch for each."""
    return b ^ ((a ^ b) * which)


class Model:
    """What the lanes of a block have learnt."""

    def __init__(self, lanes: int) -> None:
        self.after1, self.after2 = np.zeros(WHOLE, np.uint32), np.zeros(SLOTS, np.uint32)  # candidates and confidences
        self.last1, self.last2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.steps, self.met, self.missed = 0, [], []
        self.counts, self.seen = np.zeros(WHOLE, np.int64), np.zeros(WHOLE, np.uint32)
        self.right = np.stack([np.full((3, 8), 8), np.full((3, 8), 16)])  # sixteenths of hits and of candidates, by order and confidence
        self.weights = np.full((8, 3), 1 << 15)
        self.cells = np.zeros((2, 8, 8, 8), np.int64)
        self.known = np.zeros(0, np.int64)
        self.start, self.freq = np.zeros(WHOLE, np.uint32), np.zeros(WHOLE, np.uint32)
        self.escape, self.ids = 0, np.zeros(WHOLE, np.uint16)
        self.mix()

    def mix(self) -> None:
        """The probability of a hit in 12 bits for confidences of all three orders."""
        self.stretched = STRETCH[(self.right[0] * ONE // self.right[1]).clip(1, ONE - 1)]
        two, one, none = self.stretched
        w = self.weights
        dot = (two * w[:, 0])[:, None, None] + (one * w[:, 1:2])[:, :, None] + (none * w[:, 2:])[:, None, :]
        self.mixed = SQUASH[(dot >> 16).clip(-2047, 2047) + 2048]
        self.hit_p = ((self.cells[0] * ONE + self.mixed * 32) // (self.cells[1] + 32)).clip(32, ONE - 32).astype(np.uint32).ravel()

    def predict(self, n: int) -> np.ndarray:
        """For the first n lanes the probability of a hit; candidates are in self.guess."""
        last1 = self.last1[:n]
        self.slot1 = last1.astype(np.int64)
        self.slot2 = (((self.last2[:n] * np.uint32(31153) + last1) * np.uint32(2654435769)) >> np.uint32(14)).astype(np.int64)
        one, two = at(self.after1, self.slot1), at(self.after2, self.slot2)
        self.sure1, self.sure2 = one >> _S16, two >> _S16
        self.one, self.two = one & _LOW, two & _LOW
        self.guess = either(self.sure2 > 0, self.two, self.one)
        # a candidate of order 2 alone has no confidence of order 1
        cell = (self.sure2 << np.uint32(6)) + (self.sure1 << np.uint32(3)) * (self.guess == self.one) + at(self.seen, self.guess.astype(np.int64))
        self.cell = cell.astype(np.int64)
        return at(self.hit_p, self.cell)

    def learn(self, n: int, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray) -> None:
        """ids: of the first n lanes; missed: those that were no hit."""
        for table, slot, old, sure in ((self.after1, self.slot1, self.one, self.sure1), (self.after2, self.slot2, self.two, self.sure2)):
            state = (sure + np.uint32(8) * (old == ids)).astype(np.int64)
            table[slot] = either(at(STAYS, state), old, ids) | at(NEXT, state)
        self.last2[:n] = self.last1[:n]
        self.last1[:n] = ids
        self.met.append(self.cell + np.int64(512) * hit)
        self.missed.append(missed)
        self.steps += 1
        if self.steps % 32 == 0 or self.steps in EARLY:
            self.refresh()

    def refresh(self) -> None:
        met = np.bincount(np.concatenate(self.met), minlength=1024).reshape(2, 8, 8, 8)
        hits, all_met = met[1], met[0] + met[1]
        missed = np.bincount(np.concatenate(self.missed), minlength=WHOLE)
        self.met, self.missed = [], []
        # weights go down the gradient of what the last steps cost, a set for each confidence of order 2
        err = hits * ONE - all_met * self.mixed
        total = np.maximum(all_met.sum((1, 2)), 1)
        two, one, none = self.stretched
        slope = np.stack([err.sum((1, 2)) * two, (err.sum(2) * one).sum(1), (err.sum(1) * none).sum(1)], 1)
        self.weights = (self.weights + ((slope // total[:, None] * 6 * np.minimum(total, 64)[:, None]) >> 14)).clip(-(1 << 18), 1 << 18)
        self.right -= self.right >> 2
        for k, x in enumerate((hits, all_met)):
            self.right[k] += 16 * np.stack([x.sum((1, 2)), x.sum((0, 2)), x.sum((0, 1))])
        self.right[0] += 2
        self.right[1] += 4
        self.cells -= self.cells >> 2
        self.cells += np.stack([hits, all_met])
        self.mix()
        # frequencies of missed ids; what is left over is for those not met
        new = np.flatnonzero((missed > 0) & (self.counts == 0))
        if len(self.known) + len(new) > MOST_KNOWN:
            missed[new] = 0
        self.counts += missed
        self.known = known = np.flatnonzero(self.counts)
        if not len(known):
            return
        own = self.counts[known]
        escape = WHOLE * len(new) // max(int(missed.sum()), 1)
        escape = min(max(escape, 64), (WHOLE - len(known)) // 2)
        freq = 1 + own * (WHOLE - len(known) - escape) // int(own.sum())
        ends = freq.cumsum()
        self.freq[known], self.start[known] = freq, ends - freq
        self.escape = int(ends[-1])
        self.ids[: self.escape] = np.repeat(known.astype(np.uint16), freq)
        self.seen[known] = np.searchsorted(OFTEN, own, "right")


def _shape(n: int, lanes: int) -> tuple[int, int]:
    """Ids that every lane has, and how many first lanes have one more."""
    return n // lanes, n % lanes


def _active(n: int, lanes: int) -> list[int]:
    every, more = _shape(n, lanes)
    return [lanes] * every + [more] * (more > 0)


def _places(n: int, lanes: int) -> np.ndarray:
    """Where each lane begins."""
    every, more = _shape(n, lanes)
    lane = np.arange(lanes)
    return lane * every + np.minimum(lane, more)


def encode(ids: np.ndarray, most_lanes: int = LANES) -> bytes:
    """A block of ids."""
    lanes = max(1, min(most_lanes, len(ids) // LANE_IDS))
    model, first, steps = Model(lanes), _places(len(ids), lanes), []
    wide = ids.astype(np.uint32)
    for t, n in enumerate(_active(len(ids), lanes)):
        p = model.predict(n)
        own = at(wide, first[:n] + t)
        hit = own == model.guess
        miss = np.flatnonzero(~hit)
        missed = own[miss]
        place = missed.astype(np.int64)
        freq, start = at(model.freq, place), at(model.start, place)
        odd = np.flatnonzero(freq == 0)
        start[odd], freq[odd] = model.escape, WHOLE - model.escape
        steps.append((p, hit, miss, start, freq, odd, missed[odd]))
        model.learn(n, own, hit, place)
    # the coder is a stack: what is read first is written last
    state, words = np.full(lanes, WHOLE, np.uint32), []

    def put(x: np.ndarray, start: np.ndarray, freq: np.ndarray, bits: np.uint32) -> np.ndarray:
        full = np.flatnonzero((x >> (np.uint32(32) - bits)) >= freq)
        words.append(x[full].astype(np.uint16))
        x[full] >>= _S16
        q = (x / freq.astype(np.float64)).astype(np.uint32)  # exact: both are below 2 ** 32
        return (q << bits) + (x - q * freq) + start

    for p, hit, miss, start, freq, odd, rare in reversed(steps):
        n = len(p)
        if len(miss):
            x = state[miss]
            if len(odd):
                words.append(x[odd].astype(np.uint16))
                x[odd] = (x[odd] >> _S16 << _S16) + rare
            state[miss] = put(x, start, freq, _S16)
        state[:n] = put(state[:n], p * ~hit, either(hit, p, np.uint32(ONE) - p), _S12)
    body = struct.pack("<I", lanes) + state.astype("<u4").tobytes() + np.concatenate([*words[::-1], np.zeros(0, np.uint16)]).astype("<u2").tobytes()
    return struct.pack("<I", zlib.crc32(body)) + body


def decode(block: bytes, count: int) -> np.ndarray:
    """Inverse of encode; count: how many ids."""
    if len(block) < 8 or zlib.crc32(memoryview(block)[4:]) != struct.unpack_from("<I", block)[0]:
        raise ValueError("damaged block of a token segment")
    lanes = struct.unpack_from("<I", block, 4)[0]
    model = Model(lanes)
    state = np.frombuffer(block, "<u4", lanes, 8).astype(np.uint32)
    stream, read = np.frombuffer(block, "<u2", offset=8 + 4 * lanes).astype(np.uint32), 0
    every, more = _shape(count, lanes)
    rows = np.zeros((every + (more > 0), lanes), np.uint16)

    def fill(x: np.ndarray, short: np.ndarray) -> None:
        nonlocal read
        x[short] = (x[short] << _S16) | stream[read : read + len(short)]
        read += len(short)

    for t, n in enumerate(_active(count, lanes)):
        p = model.predict(n)
        x = state[:n]
        slot = x & np.uint32(ONE - 1)
        hit = slot < p
        x >>= _S12
        x *= either(hit, p, np.uint32(ONE) - p)
        x += slot - p * ~hit
        fill(x, np.flatnonzero(x < WHOLE))
        ids = model.guess.copy()
        miss = np.flatnonzero(~hit)
        missed = miss
        if len(miss):
            x = state[miss]
            slot = x & _LOW
            missed = at(model.ids, slot.astype(np.int64)).astype(np.int64)
            freq, start = at(model.freq, missed), at(model.start, missed)
            odd = np.flatnonzero(slot >= model.escape)
            freq[odd], start[odd] = WHOLE - model.escape, model.escape
            x = (x >> _S16) * freq + slot - start
            fill(x, np.flatnonzero(x < WHOLE))
            if len(odd):
                missed[odd] = x[odd] & _LOW
                x[odd] >>= _S16
                fill(x, odd)
            state[miss] = x
            ids[miss] = missed
        rows[t, :n] = ids
        model.learn(n, ids, hit, missed)
    out = np.empty(count, np.uint16)
    long = every + 1
    out[: more * long] = rows[:, :more].T.ravel()
    out[more * long :] = rows[:every, more:].T.ravel()
    return out


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS, lanes: int = LANES) -> list[tuple[int, bytes]]:
    """(number of ids, bytes) of each block of a sequence of ids."""
    return [(len(x), encode(x, lanes)) for x in cuts(ids, block)]


def cuts(ids: np.ndarray, block: int = BLOCK_IDS) -> Iterator[np.ndarray]:
    return (ids[i : i + block] for i in range(0, len(ids), block))


def decode_ids(blocks: list[tuple[int, bytes]], lanes: int = LANES) -> list[np.ndarray]:
    """Ids of each block, in the order given; blocks know their lanes."""
    return [decode(b, n) for n, b in blocks]
