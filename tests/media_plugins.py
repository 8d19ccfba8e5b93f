"""What a user would bring to the tests: a reader of a made-up video format, and a model."""

import glob
import json
import os
import uuid

import numpy as np

from twinsieve.plans import registry


class TextVideo:
    """A video whose file is JSON: fps, frames, a colour for each scene, frames that can't be read, and a log of reads."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            self.about = json.load(file)
        self.fps, self.frames, self.at = self.about["fps"], self.about["frames"], 0
        self.log = {"path": os.path.basename(path), "seeks": [], "reads": []}

    def seek(self, index):
        self.log["seeks"].append(index)
        self.at = index

    def read(self):
        at, self.at = self.at, self.at + 1
        self.log["reads"].append(at)
        if at in self.about.get("broken", []):
            return None
        scenes = self.about["scenes"]
        return picture(scenes[at * len(scenes) // self.frames])

    def close(self):
        if "log" in self.about:
            with open(f"{self.about['log']}/{uuid.uuid4().hex}", "w", encoding="utf-8") as file:
                json.dump(self.log, file)


def picture(seed):
    """A BGR picture that a seed stands for; an empty one for a negative seed."""
    if seed < 0:
        return np.zeros((0, 0, 3), np.uint8)
    return np.random.default_rng(seed).integers(0, 256, (48, 64, 3)).astype(np.uint8)


def logs_of(folder):
    found = [json.load(open(name, encoding="utf-8")) for name in glob.glob(f"{folder}/*")]
    return {entry["path"]: entry for entry in found}


class MeanModel:
    """A model that leaves a mark when it is made, and the size of each batch that it sees."""

    def __init__(self, folder=None):
        self.folder = folder

    def __call__(self):
        if self.folder:
            open(f"{self.folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(batch):
            if self.folder:
                open(f"{self.folder}/batch-{len(batch)}-{uuid.uuid4().hex}", "w").close()
            return batch.reshape(len(batch), 3, 7, 32, 7, 32).mean(axis=(3, 5)).reshape(len(batch), -1)

        return predict


registry.register_model("means", MeanModel(), width=147)
