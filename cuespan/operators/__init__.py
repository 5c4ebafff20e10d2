"""cuespan.operators"""
