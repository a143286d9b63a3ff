"""Single files in tasks, where no reader of Spark's fits."""

import re
from urllib.parse import unquote


def file_system(address):
    """(pyarrow file system, path in it) of an address as Hadoop spells it: a shared folder, hdfs, s3 or gs."""
    from pyarrow import fs

    if address.startswith(("file:", "/")):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", address)) if address.startswith("file:") else address
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", address))
