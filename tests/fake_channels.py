"""A client that reads channels from the folder that an environment file names; each call for messages is noted there."""

import json
import os
import tempfile

PLACE = os.path.join(tempfile.gettempdir(), "tonelake-fake-channels.txt")


class Client:
    def __init__(self):
        with open(PLACE) as f:
            self.folder = f.read()
        with open(os.path.join(self.folder, "messages.json")) as f:
            self.rows = json.load(f)

    def newest(self, chat_id):
        return max((r[2] for r in self.rows if r[0] == chat_id), default=0)

    def before(self, chat_id, day):
        return max((r[2] for r in self.rows if r[0] == chat_id and r[3] < day), default=0)

    def messages(self, chat_id, after, upto):
        if os.path.exists(os.path.join(self.folder, "down")):
            raise OSError("no connection")
        return [r for r in self.rows if r[0] == chat_id and after < r[2] <= upto]


def connect():
    return Client()
