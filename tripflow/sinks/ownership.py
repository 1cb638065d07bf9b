"""Which stream a stored batch belongs to.

Batch ids are only unique within one stream. Two streams into one sink would take each other's
batches for replays of their own, so a sink notes the owner of each batch.
"""


# The owner of a batch that no stream stored.
NO_STREAM = "no stream"


class ForeignBatch(RuntimeError):
    """The batch id is taken by another stream."""


def check_owner(batch_id: int, holder: str, owner: str) -> None:
    if holder != owner:
        raise ForeignBatch(
            f"batch {batch_id} is stored already, by {holder}, not by {owner}: "
            "give each stream a sink of its own"
        )
