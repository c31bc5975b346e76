"""Writing single files to local or shared folders and to stores that Arrow has file systems for."""

from __future__ import annotations

import os
import re
import uuid


def put(path: str, data: bytes) -> None:
    """Writes a file under a name of this attempt and renames it, so a repeated or lost task leaves one whole file or none."""
    if re.match(r"file:|/", path):
        target = re.sub(r"^file:(//)?", "", path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, target)
        return
    from pyarrow import fs

    system, target = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(target), recursive=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, target)
