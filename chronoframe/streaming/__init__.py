"""The stateful operators over streams: the same rules with a key's state kept between micro-batches."""
