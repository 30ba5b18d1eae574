"""Token counts under a unigram model, with forward scores shared by the prefixes of distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, counter_rows, ship, slices, string_buffers, sum_counters, word_spans

#: Begins every word.
MARK = "▁"
#: Code points of a word up to which it is put in the trie; longer ones are split alone, with bounded memory.
LONG = 256
#: Rounds in which the pieces' probabilities are estimated.
ROUNDS = 2
#: What an unseen piece counts as, and how far below the rarest piece a character without one lies.
PRIOR, UNKNOWN = 0.5, 10.0


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file, without control, unknown and byte pieces; its merge ranks are no scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """An automaton of the pieces' characters, and their scores."""

    def __init__(self, pieces: list[str], scores: np.ndarray | None = None):
        self.pieces = pieces
        self.scores = np.full(len(pieces), -1.0) if scores is None else scores
        self.unknown = float(self.scores.min(initial=0.0)) - UNKNOWN
        steps, self.ends = {}, [-1]
        for i, p in enumerate(pieces):
            state = 0
            for ch in p:
                key = state << 21 | ord(ch)
                state = steps.setdefault(key, len(self.ends))
                if state == len(self.ends):
                    self.ends.append(-1)
            self.ends[state] = i
        self.steps = steps
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.end = np.array(self.ends, np.int64)
        self.first = self._table()

    def _table(self) -> np.ndarray:
        """Next state of the start for each code point, where every word spends most steps."""
        out = np.full(0x110000, -1, np.int32)
        for k, v in self.steps.items():
            if k < 1 << 21:
                out[k] = v
        return out

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where no piece goes on."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = state << 21 | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def alone(self, word: str) -> tuple[float, int]:
        """(score, tokens) of one word without a trie; only what an open piece may need is held."""
        open_, best = [], (0.0, 0)
        for ch in word:
            code, new = ord(ch), (best[0] + self.unknown, best[1] - len(ch.encode()))
            alive = []
            for state, base in (*open_, (0, best)):
                state = self.steps.get(state << 21 | code)
                if state is not None:
                    alive.append((state, base))
                    piece = self.ends[state]
                    if piece >= 0:
                        new = max(new, (base[0] + self.scores[piece], base[1] - 1))
            open_, best = alive, new
        return float(best[0]), -best[1]


def trie_splits(words: pa.Array, pieces: Pieces, weights: np.ndarray | None = None):
    """(score, tokens) of the best split of every word, and how often each piece is used where weights are given.

    words: distinct, sorted, without nulls, of at most ``LONG`` code points with the mark. Their prefixes are the nodes of a
    trie, made level by level from neighbours in order. The best total of a node's prefix depends on the prefix
    alone, so it is computed once for all words below it, from the open pieces that it hands to its children.
    Highest score wins, then fewest tokens, then the longest last piece; a character without a piece costs its
    UTF-8 bytes as tokens.
    """
    n = len(words)
    size = np.asarray(pc.utf8_length(words)).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(string_buffers(words)[0])], np.int64)), pa.py_buffer(np.ascontiguousarray(string_buffers(words)[0])))
    code = np.frombuffer(text[0].as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
    off = np.cumsum(size) - size
    score, tokens = np.zeros(n), np.zeros(n, np.int64)
    # one node above all words: its score is 0 and no piece is open
    node, node_score, node_tokens = np.zeros(n, np.int64), np.zeros(1), np.zeros(1, np.int64)
    begin, states = np.zeros(2, np.int64), np.zeros(0, np.int64)
    base_score, base_tokens, base_node = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    same, first_of_level, levels, terminal = np.ones(n, bool), 0, [], np.zeros(n, np.int64)
    depth = 0
    active = np.arange(n)
    while True:
        active = active[size[active] > depth]
        if not len(active):
            break
        c = code[off[active] + depth]
        before = np.maximum(active - 1, 0)
        alike = same[active] & (active > 0) & (size[before] > depth)
        alike[alike] = code[off[before[alike]] + depth] == c[alike]
        same[active] = alike
        made = np.flatnonzero(~alike)
        parent, c = node[active[made]], c[made]
        node[active] = np.cumsum(~alike) - 1
        # children inherit their parent's open pieces, and open one of their own
        count = np.diff(begin)[parent]
        m = len(made)
        begins = np.concatenate([[0], np.cumsum(count + 1)])
        owner = np.repeat(np.arange(m), count + 1)
        place = np.arange(begins[-1]) - begins[owner]
        fresh = place == count[owner]
        old = np.where(fresh, 0, begin[parent[owner]] + place)
        up = parent[owner]
        st = np.where(fresh, 0, states[old] if len(states) else 0)
        bs = np.where(fresh, node_score[up], base_score[old] if len(states) else 0.0)
        bt = np.where(fresh, node_tokens[up], base_tokens[old] if len(states) else 0)
        bn = np.where(fresh, first_of_level + up, base_node[old] if len(states) else 0)
        to = np.empty(len(st), np.int64)
        to[fresh] = pieces.first[c]
        rest = ~fresh
        to[rest] = pieces.follow(st[rest], c[owner[rest]])
        keep = to >= 0
        owner, to, bs, bt, bn = owner[keep], to[keep], bs[keep], bt[keep], bn[keep]
        piece = pieces.end[to]
        new_score = node_score[parent] + pieces.unknown
        new_tokens = node_tokens[parent] + np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        chosen, source = np.full(m, -1, np.int64), first_of_level + parent
        done = np.flatnonzero(piece >= 0)
        if len(done):
            o, s, t = owner[done], bs[done] + pieces.scores[piece[done]], bt[done] + 1
            order = np.lexsort((np.arange(len(o)), t, -s, o))  # stable: pieces opened earlier, the longer ones, come first
            lead = order[np.flatnonzero(np.concatenate([[True], o[order][1:] != o[order][:-1]]))]
            at = o[lead]
            better = (s[lead] > new_score[at]) | ((s[lead] == new_score[at]) & (t[lead] < new_tokens[at]))
            lead, at = lead[better], at[better]
            new_score[at], new_tokens[at] = s[lead], t[lead]
            chosen[at], source[at] = piece[done[lead]], bn[done[lead]]
        if weights is not None:
            levels.append((chosen, source))
        first_of_level += len(node_score)
        begin = np.searchsorted(owner, np.arange(m + 1))
        states, base_score, base_tokens, base_node = to, bs, bt, bn
        node_score, node_tokens = new_score, new_tokens
        ended = active[size[active] == depth + 1]
        score[ended], tokens[ended], terminal[ended] = node_score[node[ended]], node_tokens[node[ended]], first_of_level + node[ended]
        depth += 1
    if weights is None:
        return score, tokens, None
    used = np.zeros(len(pieces.pieces), np.int64)
    total = np.zeros(first_of_level + len(node_score), np.int64)
    np.add.at(total, terminal, weights)
    end = len(total)
    for chosen, source in reversed(levels):  # a node's weight goes to its last piece and to the node before that
        w = total[end - len(chosen) : end]
        hit = chosen >= 0
        used += np.bincount(chosen[hit], weights=w[hit], minlength=len(used)).astype(np.int64)
        np.add.at(total, source, w)
        end -= len(chosen)
    return score, tokens, used


def _words(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A slice's distinct words with the mark, in order; each word's place among them; and the rows' offsets among words."""
    raw, off = string_buffers(part.column("text"))
    start, end, rows = word_spans(raw, off)
    cuts = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(raw[~SPACE[raw]])).dictionary_encode()
    order = np.asarray(pc.sort_indices(words.dictionary)).astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words.dictionary.take(pa.array(order)), pa.scalar("", pa.large_string()))
    return marked, rank[np.asarray(words.indices).astype(np.int64)], rows


def _use(table):
    """Counters of the pieces in the best splits of all words; a longer word than ``LONG`` counts as several."""

    def run(batches):
        pieces, used = table.value, None
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words, use, _ = _words(part)
                n = np.bincount(use, minlength=len(words))
                long = np.flatnonzero(np.asarray(pc.utf8_length(words)) > LONG)
                if len(long):
                    cut = {}
                    for i in long.tolist():
                        w = words[i].as_py()
                        for k in range(0, len(w), LONG):
                            cut[w[k : k + LONG]] = cut.get(w[k : k + LONG], 0) + int(n[i])
                    short = np.delete(np.arange(len(words)), long)
                    names = sorted(cut, key=lambda w: w.encode())
                    used = _add(used, trie_splits(pa.array(names, pa.large_string()), pieces, np.array([cut[w] for w in names], np.int64))[2])
                    words, n = words.take(pa.array(short)), n[short]
                used = _add(used, trie_splits(words, pieces, n)[2])
        turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows = counter_rows(used, turn) if used is not None else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "chunk", "turn", "counts"])

    return run


def _add(total, more):
    return more if total is None else total + more


def estimate(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS, text_col: str = "text") -> Pieces:
    """Unigram log-probabilities of the pieces over all documents.

    The first round splits every word into the fewest pieces; each further one into the likeliest by the counts of
    the last. Counts are whole numbers of a fixed table, so they do not depend on partitions. Without any
    document all pieces are alike.
    """
    ship(docs.sparkSession)
    text, model = docs.select(F.col(text_col).alias("text")), Pieces(pieces)
    for _ in range(rounds):
        table = docs.sparkSession.sparkContext.broadcast(model)
        rows = text.mapInArrow(_use(table), "kind int, chunk int, turn long, counts binary")
        used = sum_counters(rows, 1, len(pieces))[0] + PRIOR
        table.destroy()
        model = Pieces(pieces, np.log(used / used.sum()))
    return model


def token_counts(docs: DataFrame, pieces: str, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: the sum over its words of the tokens of their likeliest split into pieces.

    pieces: path of a sentencepiece file; only its pieces are read, their log-probabilities are estimated from the
    documents (``estimate``). Words end at the six ASCII white-space characters and begin with a mark. Each slice of
    about 2 MB puts its distinct words into a trie and sums by document; no shuffle, and memory is bounded:
    words of over ``LONG`` code points are split outside the trie. Null and empty texts have 0 words and tokens. Null and
    repeated ids are kept as they are; repeated rows count in the estimate as often as they are there. An empty
    table gives an empty result. Extra columns are ignored.
    Returns: id, n_words, n_tokens, score (sum of the splits' log-probabilities).
    """
    table = docs.sparkSession.sparkContext.broadcast(estimate(docs, load_pieces(pieces), rounds, text_col))

    def run(batches):
        model = table.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words, use, rows = _words(part)
                size = np.asarray(pc.utf8_length(words))
                short = np.flatnonzero(size <= LONG)
                score, tokens = np.zeros(len(words)), np.zeros(len(words), np.int64)
                score[short], tokens[short], _ = trie_splits(words.take(pa.array(short)), model)
                for i in np.flatnonzero(size > LONG).tolist():
                    score[i], tokens[i] = model.alone(words[i].as_py())
                count = np.diff(rows)
                row = np.repeat(np.arange(len(count)), count)
                total = lambda v: np.bincount(row, weights=v[use], minlength=len(count)) if len(use) else np.zeros(len(count))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count.astype(np.int64)), pa.array(total(tokens).astype(np.int64)), pa.array(total(score))], ["id", "n_words", "n_tokens", "score"])

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.mapInArrow(run, "id long, n_words long, n_tokens long, score double").withColumnRenamed("id", id_col)
