"""Clients of a live graph: every new version goes to all of them, and they may ask for the graph or dismiss changes.

A client is a function that takes a message, a JSON text; whatever carries messages (a socket, a queue, a file) is wrapped in one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from deploom.api import to_json
from deploom.operators import document

from .live import LiveGraph

Send = Callable[[str], object]


class Clients:
    """Clients that are told of each version of a graph.

    A client that reads the shared storage gets the folder of the version's document, which tasks write once a version; the others get it as text, which must fit
    the driver and is not made while there are none of them.
    """

    def __init__(self, graph: LiveGraph):
        self.graph, self.connected = graph, []
        self.by_folder: list[Send] = []
        self.folder_version = -1
        graph.after.append(self.broadcast)

    def document(self) -> str:
        nodes, edges = self.graph.view()
        return f'{{"type": "graph_update", "data": {to_json(nodes.drop("cfg", "pdg"), edges)}}}'

    def folder_message(self) -> str:
        """Names the folder of the document of this version, whose text files joined by name are the JSON; it goes with the version."""
        version = self.graph.version
        path = f"{self.graph.folder}/document/v={version}"
        if self.folder_version != version:
            nodes, edges = self.graph.view()
            document.write_document(document.document(nodes.drop("cfg", "pdg"), edges), path)
            self.folder_version = version
        return json.dumps({"type": "graph_update", "version": version, "folder": path})

    def update(self, clients: list[Send]) -> None:
        """Sends the graph to clients, each in its own form."""
        folder, text = [c for c in clients if c in self.by_folder], [c for c in clients if c not in self.by_folder]
        if folder:
            self.deliver(self.folder_message(), folder)
        if text:
            self.deliver(self.document(), text)

    def connect(self, send: Send, by_folder: bool = False) -> None:
        """Adds a client, which gets the graph at once if there is one."""
        self.connected.append(send)
        if by_folder:
            self.by_folder.append(send)
        if self.graph.version >= 0:
            self.update([send])

    def deliver(self, text: str, clients: list[Send]) -> None:
        """Sends a message to clients; those that fail are taken off the list, the others still get it."""
        for send in list(clients):
            try:
                send(text)
            except Exception:  # the client is gone, whatever it raised
                self.connected = [c for c in self.connected if c != send]
                self.by_folder = [c for c in self.by_folder if c != send]

    def broadcast(self) -> None:
        if self.connected:
            self.update(self.connected)

    def receive(self, text: str, send: Send) -> None:
        """One message of a client. The types ping and request_graph are answered by pong and the graph; the actions dismiss_change (whose data
        has a node_id) and dismiss_all_changes clear statuses, upon which all clients get the graph. Other texts change nothing."""
        try:
            message = json.loads(text)
        except ValueError:
            return
        if not isinstance(message, dict):
            return
        data = message.get("data") if isinstance(message.get("data"), dict) else {}
        if message.get("type") == "ping":
            self.deliver(json.dumps({"type": "pong"}), [send])
        elif message.get("type") == "request_graph":
            self.update([send])
        elif message.get("action") == "dismiss_change" and data.get("node_id"):
            self.graph.dismiss(data["node_id"])
        elif message.get("action") == "dismiss_all_changes":
            self.graph.dismiss()
