"""Sources of pixels, frames and arrays."""
