"""cuespan.sources"""
