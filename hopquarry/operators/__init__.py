"""Set-oriented operators: frames in, frames out."""
