"""DataFrame -> DataFrame operators; the recording (``shot``) is always part of the key."""
