"""A backend for tests: tells the length and the level of every chunk; one length is poison."""

import numpy as np

from earshot.plans import models

POISON = 4321


class Loud:
    def transcribe(self, waves, language, task):
        if any(len(w) == POISON for w in waves):
            raise ValueError("poison")
        return [(f" n{len(w)} s{int(np.abs(w).sum())} " if len(w) % 5 else "", "ja" if len(w) % 2 else language) for w in waves]


models.register("wav2vec2", lambda name: Loud())
