"""A bidirectional LSTM over characters with CRF transitions between tags, trained and applied in numpy.

Tags are 0 (outside) and, for kind k, 1 + 2k (a span begins) and 2 + 2k (it goes on). Windows are columns: arrays go (step, window, ...).
Gates are ordered input, forget, output, candidate; a row of `inputs` for each class of characters takes the place of an embedding with its bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes: ASCII by code point, then letters beyond ASCII, other characters beyond ASCII, and nothing (before or after a text).
LETTER, OTHER, NOTHING = 128, 129, 130
CLASSES = 131
_NEVER = np.float32(-1e4)


def class_table() -> np.ndarray:
    """Class of each code point below 0x3000; all beyond count as letters."""
    return np.array([c if c < 128 else LETTER if chr(c).isalpha() else OTHER for c in range(0x3000)], np.uint8)


_TABLE = class_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], np.uint8(LETTER))


@dataclass
class Tagger:
    kinds: int
    hidden: int
    inputs: list[np.ndarray]  # forward, backward: classes x 4 hidden
    loops: list[np.ndarray]  # forward, backward: hidden x 4 hidden
    out: np.ndarray  # 2 hidden x tags
    bias: np.ndarray  # tags
    moves: np.ndarray  # tags x tags

    @staticmethod
    def fresh(kinds: int, hidden: int, seed: int) -> Tagger:
        rng, tags = np.random.default_rng(seed), 1 + 2 * kinds
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        inputs = [draw(CLASSES, 4 * hidden, by=0.4) for _ in range(2)]
        for x in inputs:
            x[:, hidden : 2 * hidden] += 1
        return Tagger(kinds, hidden, inputs, [draw(hidden, 4 * hidden, by=hidden**-0.5) for _ in range(2)], draw(2 * hidden, tags, by=0.3), np.zeros(tags, np.float32), draw(tags, tags, by=0.1))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.loops, self.out, self.bias, self.moves]

    def allowed(self) -> np.ndarray:
        """moves, with those to the inside of a span that has not begun ruled out."""
        m = self.moves.copy()
        for k in range(self.kinds):
            others = np.ones(len(m), bool)
            others[[1 + 2 * k, 2 + 2 * k]] = False
            m[others, 2 + 2 * k] = _NEVER
        return m

    def _states(self, classes: np.ndarray, side: int) -> np.ndarray:
        """Hidden states of one direction at all steps, without keeping what training needs."""
        h4, n = self.hidden, classes.shape[1]
        halves = np.full(4 * h4, 0.5, np.float32)
        halves[3 * h4 :] = 1  # a sigmoid is a tanh of half the size
        table, loop = self.inputs[side] * halves, self.loops[side] * halves
        out = np.empty((*classes.shape, h4), np.float32)
        h, c, z, turn = np.zeros((n, h4), np.float32), np.zeros((n, h4), np.float32), np.empty((n, 4 * h4), np.float32), np.empty((n, h4), np.float32)
        for t in range(len(classes)) if side == 0 else range(len(classes) - 1, -1, -1):
            np.matmul(h, loop, out=z)
            z += table[classes[t]]
            np.tanh(z, out=z)
            gates = z[:, : 3 * h4]
            gates *= 0.5
            gates += 0.5
            c *= z[:, h4 : 2 * h4]
            np.multiply(z[:, :h4], z[:, 3 * h4 :], out=turn)
            c += turn
            np.tanh(c, out=turn)
            h = out[t]
            np.multiply(z[:, 2 * h4 : 3 * h4], turn, out=h)
        return out

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """Scores of the tags at each step of each window, against those of tag 0."""
        states = np.concatenate([self._states(classes, 0), self._states(classes, 1)], 2)
        e = states.reshape(-1, 2 * self.hidden) @ (self.out - self.out[:, :1]) + (self.bias - self.bias[0])
        return e.reshape(*classes.shape, -1)

    def hopeful(self, e: np.ndarray) -> np.ndarray:
        """Windows that may hold a span: in all others no path can beat the one that stays outside.

        Each step of a span adds its emission and at most the best move to its tag. `best` is the most that a run of steps up to here
        can add, whatever their kinds; if it never makes up for the best move out, no span of the window is worth its moves.
        """
        m = self.allowed() - self.moves[0, 0]
        into = m.max(0)
        first, further = (e[:, :, 1::2] + into[1::2]).max(2), (e[:, :, 2::2] + into[2::2]).max(2)
        first[0] = e[0, :, 1::2].max(1)  # no move leads to the first step of a window
        best = most = first[0]
        for t in range(1, len(e)):
            best = np.maximum(best + np.maximum(first[t], further[t]), first[t])
            most = np.maximum(most, best)
        return np.flatnonzero(most + max(float(m[1:, 0].max()), 0.0) > 0)

    def paths(self, e: np.ndarray) -> np.ndarray:
        """Best tags (step, window)."""
        m = self.allowed()
        score = e[0].copy()
        score[:, 2::2] = _NEVER
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            all_ways = score[:, :, None] + m
            back[t] = all_ways.argmax(1)
            score = all_ways.max(1) + e[t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[-1] = score.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), 1)[:, 0]
        return tags

    def spans(self, classes: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(window, start, end, kind, gain over staying outside) of the spans of the best paths; start and end count steps."""
        e = self.emissions(classes)
        at = self.hopeful(e)
        if not len(at):
            return []
        e = e[:, at]
        tags, m, found = self.paths(e), self.moves, []
        for w, s in zip(*np.nonzero((tags % 2 == 1).T), strict=True):
            own, end = tags[s, w], s + 1
            while end < len(tags) and tags[end, w] == own + 1:
                end += 1
            steps = tags[s:end, w]
            gain = e[np.arange(s, end), w, steps].sum() + m[steps[:-1], steps[1:]].sum() - (end - s - 1) * m[0, 0]
            gain += (m[0, own] - m[0, 0] if s else 0) + (m[steps[-1], 0] - m[0, 0] if end < len(tags) else 0)
            found.append((int(at[w]), int(s), int(end), (int(own) - 1) // 2, float(gain)))
        return found

    def gradients(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(mean negative log-likelihood of the tags of a window, its gradient by each parameter)."""
        kept = [self._forward(classes, side) for side in range(2)]
        states = np.concatenate([k[0] for k in kept], 2)
        e = states @ self.out + self.bias
        loss, d_e, d_moves = self._likelihood(e, tags)
        flat = d_e.reshape(-1, d_e.shape[2])
        d_out, d_states = states.reshape(-1, 2 * self.hidden).T @ flat, d_e @ self.out.T
        sides = [self._backward(classes, side, *kept[side], d_states[:, :, side * self.hidden : (side + 1) * self.hidden]) for side in range(2)]
        return loss, [sides[0][0], sides[1][0], sides[0][1], sides[1][1], d_out, flat.sum(0), d_moves]

    def _forward(self, classes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden states, gates, cells) at all steps."""
        n, k = classes.shape[1], self.hidden
        hs, gates, cells = (np.empty((*classes.shape, d), self.out.dtype) for d in (k, 4 * k, k))
        h = c = np.zeros((n, k), self.out.dtype)
        for t in range(len(classes)) if side == 0 else range(len(classes) - 1, -1, -1):
            z = self.inputs[side][classes[t]] + h @ self.loops[side]
            z[:, : 3 * k] = 0.5 * np.tanh(0.5 * z[:, : 3 * k]) + 0.5
            z[:, 3 * k :] = np.tanh(z[:, 3 * k :])
            c = c * z[:, k : 2 * k] + z[:, :k] * z[:, 3 * k :]
            h = z[:, 2 * k : 3 * k] * np.tanh(c)
            hs[t], gates[t], cells[t] = h, z, c
        return hs, gates, cells

    def _backward(self, classes: np.ndarray, side: int, hs: np.ndarray, gates: np.ndarray, cells: np.ndarray, d_hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, last = classes.shape[1], self.hidden, len(classes) - 1
        d_inputs, d_loop = np.zeros_like(self.inputs[side]), np.zeros_like(self.loops[side])
        d_h = d_c = nothing = np.zeros((n, k), hs.dtype)
        all_z = np.empty_like(gates)
        for t in range(last, -1, -1) if side == 0 else range(last + 1):
            before = t - 1 if side == 0 else t + 1
            h0, c0 = (hs[before], cells[before]) if 0 <= before <= last else (nothing, nothing)
            i, f, o, g = (gates[t][:, j * k : (j + 1) * k] for j in range(4))
            d_h = d_h + d_hs[t]
            bent = np.tanh(cells[t])
            d_c = d_c + d_h * o * (1 - bent**2)
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), d_h * bent * o * (1 - o), d_c * i * (1 - g**2)], 1)
            all_z[t] = d_z
            d_loop += h0.T @ d_z
            d_h, d_c = d_z @ self.loops[side].T, d_c * f
        np.add.at(d_inputs, classes.ravel(), all_z.reshape(-1, 4 * k))
        return d_inputs, d_loop

    def _likelihood(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Forward-backward over the paths; no path begins inside a span."""
        steps, n, k = e.shape
        m = self.allowed().astype(e.dtype)
        weight = np.exp(m)
        ahead, scale = np.empty_like(e), np.zeros(n, e.dtype)
        peak = e.max(2, keepdims=True)
        x = np.exp(e - peak)
        for t in range(steps):
            a = x[t] * (ahead[t - 1] @ weight if t else np.where(np.arange(k) % 2 + (np.arange(k) == 0) > 0, 1.0, 0.0).astype(e.dtype))
            total = a.sum(1, keepdims=True)
            ahead[t] = a / total
            scale += np.log(total[:, 0]) + peak[t, :, 0]
        rest, share, d_moves = np.ones((n, k), e.dtype), np.empty_like(e), np.zeros_like(self.moves)
        for t in range(steps - 1, -1, -1):
            p = ahead[t] * rest
            share[t] = p / p.sum(1, keepdims=True)
            if t:
                on = x[t] * rest
                norm = ((ahead[t - 1] @ weight) * on).sum(1, keepdims=True)
                d_moves += weight * (ahead[t - 1].T @ (on / norm))
                rest = on @ weight.T
                rest /= rest.sum(1, keepdims=True)
        step, window = np.meshgrid(np.arange(steps), np.arange(n), indexing="ij")
        own = e[step, window, tags].sum() + m[tags[:-1], tags[1:]].sum()
        share[step, window, tags] -= 1
        np.subtract.at(d_moves, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        return float((scale.sum() - own) / n), share / n, d_moves / n

    def train(self, classes: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        """Adam over shuffled batches of windows, with a rate that falls to a tenth."""
        rng, steps = np.random.default_rng(seed), 0
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        n = classes.shape[1]
        rounds = epochs * max(1, n // batch)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(n), max(1, n // batch)):
                _, grads = self.gradients(classes[:, at], tags[:, at])
                size = np.sqrt(sum(float((g**2).sum()) for g in grads))
                steps += 1
                now = rate * (1 - 0.9 * steps / rounds)
                for p, g, a, b in zip(self.parameters(), grads, first, second, strict=True):
                    g = g * min(1.0, 5 / max(size, 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.01 * (g**2 - b)
                    p -= now * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-6)
