"""cuespan.streaming"""
