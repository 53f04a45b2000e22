"""diffproto: few-shot classification of text pairs by prototype vectors, on Spark.

Pairs of texts (a claim and its evidence) are turned into vectors, the
absolute difference of each pair's vectors is averaged per class into a
prototype, and every other pair is labelled by its nearest prototype.
Sampling, encoding, prototypes, scoring, evaluation, sweeps over
(encoder, seed, shots), prototype drift and run-log summaries are all
DataFrame -> DataFrame operators.

Layout:
  sources/    readers for nested claims, corpora, run logs and drift tables;
              fixture views over the driver tables
  functions/  Column -> Column helpers (text, labels, hashing, vectors)
  operators/  sampling, encoding, prototypes, evaluation, drift, summaries,
              supervised baseline
  plans/      whole experiments and sweeps, sinks, size-checked broadcast
"""

__version__ = "0.1.0"
